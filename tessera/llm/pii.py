"""Personal data by a semi-Markov conditional random field.

A text is scanned for the base patterns (e-mail, ip, card, phone), each in one linear pass.
What they miss (numbers written together, without a plus sign, with other separators, masked
addresses) is left to a semi-Markov model.  Around every run of digits and every at sign the
text is cut into atoms; segments of at most ``MAX_ATOMS`` atoms and ``MAX_CHARS`` code points
are candidates for an entity.  A candidate is scored as a whole span: its shape, number of
digits and groups, check digit, separators, and what stands on both sides.  Dynamic
programming over the atoms picks boundaries and types at once: the best sequence of entity
segments and single outside atoms, with weights for types that follow each other.

No candidate leaves its line or its island, and outside atoms score 0, so each island is
decoded alone and exactly.  Training maximises the conditional log likelihood by the
forward-backward recursion over the same segments, on islands of a bounded, hash-chosen
sample of rows.  Labels are the base matches; every labelled island also comes in forms that
the patterns do not read, and in forms that are no personal data (a wrong check digit, a part
over 255, too few digits).  An island where several numbers are joined into one failing match
is left out, since nothing says what it holds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Bounds of an entity: atoms, code points, digits.
MAX_ATOMS, MAX_CHARS, MIN_DIGITS, MAX_DIGITS = 18, 64, 6, 19
#: Rows in the sample, islands taken from one of them and their size, passes over them.
FIT_ROWS, FIT_ISLANDS, FIT_CHARS, ROUNDS = 4000, 8, 1000, 60
#: Weights of the features; an entity has to win over the outside by ``MARGIN``.
BUCKETS, MARGIN = 1 << 14, 1.0
#: Candidates scored, and positions decoded, before what is settled is handed on.
BLOCK = 1024

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    """A decimal of any length that is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, holds) of every base match, by kind and start; ``holds`` tells whether
    it passes its kind's check.  Linear in the text whatever it holds."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = max(done, text.rfind("@", done, at) + 1)
        local = text[low:at]
        n = len(local) - len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if n else None
        if m:
            out.append((0, at - n, m.end(), True))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if text.find(".", m.start(), m.end()) < 0:
            continue
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            out.append((1, start, end, all(map(small, four))))
            start = end + 1
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() > 1:
            digits = only_digits(m[0]) if m.end() - m.start() < 39 else ""
            out.append((2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    for m in _PLUS.finditer(text):
        out.append((3, m.start(), m.end(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15))
    return out


_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[ \t]+|.", re.S)
#: What an entity may be cut out of: digits, and signs or words that stand for an at sign.
_SEED = re.compile(r"[0-9]+|@|[\[(] ?(?i:at) ?[\])]")
#: No candidate goes over these, so a text may be cut at them.
_BREAK = re.compile(r"[\n\r]|[^\x00-\x7f]")


class Island(NamedTuple):
    """A stretch of a text that may hold entities; ``start`` is its place in the text, ``left``
    and ``right`` what stands beside it."""
    text: str
    start: int
    left: str
    right: str


def islands(text: str) -> Iterator[Island]:
    """What lies within ``MAX_CHARS`` of a seed and in one line of ASCII, in order and disjoint.
    Runs of digits too long for an entity are no seeds."""
    low = high = -1

    def cut(low: int, high: int) -> Iterator[Island]:
        at = low
        for m in chain(_BREAK.finditer(text, low, high), [None]):
            end = m.start() if m else high
            if end > at and _SEED.search(text, at, end):
                yield Island(text[at:end], at, text[max(0, at - 24):at], text[end:end + 1])
            at = m.end() if m else high
    for m in _SEED.finditer(text):
        if m.end() - m.start() > MAX_CHARS:
            continue
        if low >= 0 and m.start() - MAX_CHARS > high:
            yield from cut(low, high)
            low = -1
        if low < 0:
            low = max(0, m.start() - MAX_CHARS)
        high = min(len(text), m.end() + MAX_CHARS)
    if low >= 0:
        yield from cut(low, high)


_MASKED_AT = re.compile(r"@|[\[(] ?at ?[\])]| at ", re.I)
_MASKED_DOT = re.compile(r"\[\.\]|[\[(] ?dot ?[\])]| dot ", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def candidates(isl: Island) -> Iterator[tuple[int, int]]:
    """(start, end) of every segment that may be an entity, as offsets in the island, by start.

    It starts with a letter, digit, plus sign or parenthesis, ends with a letter or digit, cuts
    no word, and is an address (an at sign, then a dot) or a number without letters of
    ``MIN_DIGITS`` to ``MAX_DIGITS`` digits."""
    text = isl.text
    edges = np.fromiter((m.start() for m in _ATOM.finditer(text)), np.int64)
    atoms = len(edges)
    for i in range(atoms):
        start = int(edges[i])
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        before = text[start - 1] if start else isl.left[-1:]
        if before.isalnum() and before.isascii() and text[start].isalnum():
            continue
        digits, letters, at, dot = 0, False, False, False
        for j in range(i, min(atoms, i + MAX_ATOMS)):
            a, b = int(edges[j]), int(edges[j + 1]) if j + 1 < atoms else len(text)
            if b - start > MAX_CHARS:
                break
            c = text[a]
            if c.isdigit():
                digits += b - a
            elif c.isalpha():
                word = text[a:b].lower()
                dot |= at and word == "dot"
                at |= word == "at"
                letters = True
            else:
                at |= c == "@"
                dot |= at and c == "."
                continue
            if digits > MAX_DIGITS and not at or letters and not at and j - i > 8:
                break
            after = text[b] if b < len(text) else isl.right
            if (at and dot or not letters and MIN_DIGITS <= digits <= MAX_DIGITS) and not (
                    after.isalnum() and after.isascii()):
                yield start, b


_DIGITS = re.compile("[0-9]+")
_LETTERS = re.compile("[A-Za-z]+")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")


def features(isl: Island, start: int, end: int) -> list[int]:
    """Numbers of the whole-span features that hold."""
    span = isl.text[start:end]
    before = (isl.left + isl.text[max(0, start - 24):start])[-24:]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    n = len(digits)
    plain = _MASKED_DOT.sub(".", _MASKED_AT.sub("@", span))
    rest = _DIGITS.sub("0", _LETTERS.sub("a", span))
    left, right = before[-1:], isl.text[end:end + 1] or isl.right
    word = _BEFORE.search(before)
    parts = plain.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    signs = "".join(sorted(set(rest) - {"a", "0"}))
    has = [
        "bias", "n=%d" % min(n, 21), "groups=%d" % min(len(groups), 8), "signs=" + signs,
        "shape=" + "-".join(str(len(g)) for g in groups[:8]) if not _LETTERS.search(span) else "letters",
        "luhn" if 13 <= n <= 19 and luhn(digits) else "noluhn" if 13 <= n <= 19 else "n/a",
        "four" if four else "notfour", "plus" if span[0] == "+" else "paren" if span[0] == "(" else "none",
        "mail" if _NAME.fullmatch(plain) else "masked" if "@" in plain else "noat",
        "dots=%d" % min(4, plain.count(".")),
        "left=" + _side(left), "right=" + _side(right), "sides=" + _side(left) + _side(right),
        "paired" if span.count("(") == span.count(")") else "unpaired",
        "even" if len({len(g) for g in groups}) == 1 else "uneven",
        "word=" + (word[1].lower() if word else ""),
    ]
    return [zlib.crc32(h.encode()) % BUCKETS for h in has]


def _side(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" \
        if c.isspace() else c if c.isascii() else "other"


class Model(NamedTuple):
    """Weights per type and feature, and of a type after a type (0: outside, then ``KINDS``)."""
    span: np.ndarray  # BUCKETS x kinds
    step: np.ndarray  # (kinds + 1) x (kinds + 1)


def best_spans(isl: Island, m: Model, margin: float = MARGIN) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation, as offsets in the island; the outside wins
    ties.

    Outside atoms score 0, also after one another, so only offsets where a candidate starts or
    ends are positions of the lattice.  They are passed in order; what all open paths agree on
    is handed on and forgotten, so a long island needs no more memory than a short one."""
    kinds, none, step = len(KINDS), -math.inf, m.step.tolist()
    best, back = {0: [0.0] + [none] * kinds}, {0: [None] * (kinds + 1)}
    pending, done, at = [0], 0, 0  # positions to pass, the position all paths share

    def enter(pos: int) -> list[float]:
        if pos not in best:
            best[pos], back[pos] = [none] * (kinds + 1), [None] * (kinds + 1)
            heappush(pending, pos)
        return best[pos]

    def outside(pos: int, nxt: int) -> None:
        row, into = best[pos], enter(nxt)
        for k in range(kinds + 1):
            if row[k] + step[k][0] > into[0]:
                into[0], back[nxt][0] = row[k] + step[k][0], (pos, k)

    def trace(pos: int, k: int) -> list[tuple[int, int, int]]:
        out = []
        while back[pos][k]:
            start, before = back[pos][k]
            if k:
                out.append((k - 1, start, pos))
            pos, k = start, before
        return out[::-1]

    def settle() -> list[tuple[int, int, int]]:
        """Spans up to the last point that all open paths go through."""
        open_ = {(p, k) for p in pending for k in range(kinds + 1) if best[p][k] > none}
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            if not back[top[0]][top[1]]:
                return []
            open_.add(back[top[0]][top[1]])
        pos, k = open_.pop()
        out = trace(pos, k)
        back[pos][k] = None
        for p in [p for p in best if p < pos]:
            del best[p], back[p]
        return out

    def pass_to(limit: int) -> None:
        """Passes positions below ``limit``: from each the outside leads to the next one."""
        nonlocal at
        while pending and pending[0] < limit:
            at = heappop(pending)
            outside(at, min(pending[0], limit) if pending else limit)
    todo = candidates(isl)
    while block := list(islice(todo, BLOCK)):
        feats = np.array([features(isl, a, b) for a, b in block])
        scores = (m.span[feats].sum(axis=1) - margin).tolist()
        for (a, b), score in zip(block, scores):
            pass_to(a)
            enter(a)
            row, into, how = best[a], enter(b), back[b] if b in back else None
            for kind in range(1, kinds + 1):
                for k in range(kinds + 1):
                    v = row[k] + step[k][kind] + score[kind - 1]
                    if v > into[kind]:
                        into[kind], how[kind] = v, (a, k)
        yield from settle()
    end = len(isl.text) + 1
    pass_to(end)
    yield from trace(end, 0)


class Lattice(NamedTuple):
    """The candidates of an island on its positions: first, end (both ascending numbers of
    positions, the last one is ``size``) and features (same length in each)."""
    size: int
    first: np.ndarray
    end: np.ndarray
    feats: np.ndarray


def lattice(isl: Island) -> tuple[Lattice, list[tuple[int, int]]] | None:
    spans = list(candidates(isl))
    if not spans:
        return None
    places = {p: i for i, p in enumerate(sorted({x for s in spans for x in s} | {-1, len(isl.text) + 1}))}
    return Lattice(len(places) - 1, np.array([places[a] for a, _ in spans]),
                   np.array([places[b] for _, b in spans]),
                   np.array([features(isl, a, b) for a, b in spans])), spans


def expectations(lat: Lattice, scores: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z, the probability of every candidate and kind, and the expected type changes, by
    the forward-backward recursion over segments."""
    kinds, none = len(KINDS), -math.inf
    first, end = lat.first.tolist(), lat.end.tolist()
    starting = defaultdict(list)
    for c, p in enumerate(first):
        starting[p].append(c)
    fore, into = np.full((lat.size + 1, kinds + 1), none), np.full((lat.size + 1, kinds + 1), none)
    fore[0, 0] = 0.0
    add = np.logaddexp
    for p in range(lat.size):
        into[p] = add.reduce(fore[p][:, None] + step, axis=0)  # by the type that comes next
        fore[p + 1, 0] = into[p, 0]
        for c in starting[p]:
            fore[end[c], 1:] = add(fore[end[c], 1:], into[p, 1:] + scores[c])
    behind, out = np.full((lat.size + 1, kinds + 1), none), np.full((lat.size + 1, kinds + 1), none)
    behind[lat.size] = 0.0
    for p in range(lat.size - 1, -1, -1):
        out[p, 0] = behind[p + 1, 0]  # all that follows, by the type that comes next
        for c in starting[p]:
            out[p, 1:] = add(out[p, 1:], scores[c] + behind[end[c], 1:])
        behind[p] = add.reduce(step + out[p], axis=1)
    z = float(add.reduce(fore[lat.size]))
    change = np.exp(fore[:, :, None] + step + out[:, None, :] - z)[:-1].sum(axis=0)
    share = np.exp(into[lat.first, 1:] + scores + behind[lat.end, 1:] - z)
    return z, share, change


class Example(NamedTuple):
    """An island's lattice with its true segments: candidate -> kind."""
    lat: Lattice
    gold: dict[int, int]


def path_changes(ex: Example) -> np.ndarray:
    """How often a type follows a type in the true segmentation."""
    out = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    starts = {int(ex.lat.first[c]): (int(ex.lat.end[c]), k + 1) for c, k in ex.gold.items()}
    at, before = 0, 0
    while at < ex.lat.size:
        nxt, kind = starts.get(at, (at + 1, 0))
        out[before, kind] += 1
        at, before = nxt, kind
    return out


def train(examples: list[Example], rounds: int = ROUNDS, rate: float = 0.3, ridge: float = 0.02) -> Model:
    """Maximises the conditional log likelihood less ``ridge`` times the squared weights, by
    full-gradient steps scaled per weight.  That the outside follows itself has weight 0, which
    the scale of scores leaves free.  Without examples all weights are 0."""
    kinds = len(KINDS)
    span, step = np.zeros((BUCKETS, kinds)), np.zeros((kinds + 1, kinds + 1))
    if not examples:
        return Model(span, step)
    seen_span, seen_step = np.full_like(span, 1e-8), np.full_like(step, 1e-8)
    feats = np.concatenate([ex.lat.feats for ex in examples])
    cuts = np.cumsum([len(ex.lat.feats) for ex in examples])[:-1]
    true = np.zeros((len(feats), kinds))
    for ex, part in zip(examples, np.split(true, cuts)):
        for c, k in ex.gold.items():
            part[c, k] = 1  # a view
    changes = sum(path_changes(ex) for ex in examples)
    for _ in range(rounds):
        scores = np.split(span[feats].sum(axis=1), cuts)
        found = [expectations(ex.lat, s, step) for ex, s in zip(examples, scores)]
        diff = true - np.concatenate([share for _, share, _ in found])
        up_span = -ridge * span
        np.add.at(up_span, feats.ravel(), np.repeat(diff, feats.shape[1], axis=0))
        up_step = changes - sum(change for _, _, change in found) - ridge * step
        up_step[0, 0] = 0.0
        seen_span += up_span ** 2
        seen_step += up_step ** 2
        span = span + rate * up_span / np.sqrt(seen_span)
        step = step + rate * up_step / np.sqrt(seen_step)
    return Model(span, step)


def rewritten(kind: int, span: str) -> list[str]:
    """Forms of a base match that its pattern does not read (some patterns still do)."""
    if kind == 0:
        name, host = span.split("@", 1)
        return [f"{name} [at] {host}", f"{name}(at){host.replace('.', '(dot)')}",
                f"{name} at {host.replace('.', ' dot ')}"]
    if kind == 1:
        return [span.replace(".", "[.]")]
    digits = only_digits(span)
    if kind == 2:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "-".join(fours)]
    if len(digits) < 10:
        return []
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]


def broken(kind: int, span: str) -> list[str]:
    """Forms of a base match that are no personal data."""
    if kind == 1:
        return ["%d.%s" % (256 + len(span) * 31, span.split(".", 1)[1])]
    if kind == 2:
        return [span[:-1] + str((int(span[-1]) + 1) % 10)]
    return [span[:-5]] if kind == 3 and span[-5] != "(" else []


def _joined(span: str, kind: int) -> bool:
    """Whether a failing match may be several numbers that the pattern took for one."""
    digits = len(only_digits(span))
    return kind == 2 and digits >= 13 and digits < len(span) or kind == 3 and digits > 15


def examples_of(text: str) -> Iterator[Example]:
    """The islands of a text with their labels, and with one label's span in another form."""
    found = base_matches(text)
    for isl in islice(islands(text), FIT_ISLANDS):
        low, high = isl.start, isl.start + len(isl.text)
        here = [m for m in found if m[1] < high and m[2] > low]
        good = _disjoint([m for m in here if m[3] and low <= m[1] and m[2] <= high])
        if high - low > FIT_CHARS or any(_joined(text[m[1]:m[2]], m[0]) for m in here if not m[3]):
            continue
        spans = [(k, a - low, b - low) for k, a, b, _ in good]
        forms = [(isl, spans)]
        for i, (kind, a, b) in enumerate(spans):
            for new, holds in [*((x, True) for x in rewritten(kind, isl.text[a:b])),
                               *((x, False) for x in broken(kind, isl.text[a:b]))]:
                shift = len(new) - (b - a)
                forms.append((isl._replace(text=isl.text[:a] + new + isl.text[b:]), [
                    (k, x + (shift if x >= b else 0), y + (shift if y >= b else 0))
                    for j, (k, x, y) in enumerate(spans) if holds or j != i]))
        for form, labels in forms:
            built = lattice(form)
            if built:
                lat, where = built[0], {s: c for c, s in enumerate(built[1])}
                if all((a, b) in where for _, a, b in labels):
                    yield Example(lat, {where[a, b]: k for k, a, b in labels})


def _disjoint(matches: list) -> list:
    """The matches without those that overlap an earlier kind's."""
    out: list = []
    for m in sorted(matches):
        if all(m[2] <= o[1] or o[2] <= m[1] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: m[1])


def fit(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> Model:
    """The model of a sample of about ``FIT_ROWS`` rows by the hash of id and text."""
    n, text = docs.count(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    share = min(1.0, FIT_ROWS / max(1, n))
    picked = F.xxhash64(F.col(id_col).cast("string"), text) <= int((1 << 63) * (2 * share - 1)) - 1
    sample = docs.filter(picked if share < 1 else F.lit(True)).select(text.alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                rows = [(ex.lat.size, ex.lat.first.tolist(), ex.lat.end.tolist(), ex.lat.feats.tolist(),
                         list(ex.gold), list(ex.gold.values())) for ex in examples_of(t.as_py())]
                cols = list(zip(*rows)) or [()] * 6
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (
                        pa.int32(), ints, ints, pa.list_(ints), ints, ints))],
                    names=["size", "first", "end_", "feats", "gold", "kind"])
    rows = sample.mapInArrow(run, "size int, first array<int>, end_ array<int>, feats array<array<int>>, "
                                  "gold array<int>, kind array<int>").distinct().collect()  # a bounded sample
    rows.sort(key=lambda r: (r["size"], r["first"], r["end_"], r["feats"], r["gold"]))
    return train([Example(Lattice(r["size"], np.array(r["first"]), np.array(r["end_"]), np.array(r["feats"])),
                          dict(zip(r["gold"], r["kind"]))) for r in rows])


def find(text: str, m: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans the model adds), each (kind, start, end) by kind and start.  A span
    of the model that overlaps a base span adds nothing."""
    base = [(k, a, b) for k, a, b, holds in base_matches(text) if holds]
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for isl in islands(text):
        for k, a, b in best_spans(isl, m):
            if not _overlaps(taken, isl.start + a, isl.start + b):
                added.append((k, isl.start + a, isl.start + b))
    return base, sorted(added)


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a sorted span meets [a, b); spans of four kinds overlap at most four deep, and
    one that reaches ``a`` starts among those before it."""
    lo, hi = 0, len(taken)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if taken[mid][0] < b else (lo, mid)
    return any(y > a for _, y in taken[max(0, lo - 8):lo])


def personal_data(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  model: Model | None = None) -> DataFrame:
    """Per row: id and spans, an array of (kind, start, end, base) in code points by kind (in the
    order of ``KINDS``), then start.  ``base`` tells the patterns' spans from the model's.

    Without ``model`` one is trained on a sample of ``docs``; where no base match occurs in it
    nothing is added.  Null and empty texts have no spans; repeated rows each return; an empty
    table returns none; other columns are ignored.  Texts are read whole, however long."""
    shared = model or fit(spark, docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("base", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                base, added = find(t.as_py(), shared)
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                out.append([{"kind": KINDS[k], "start": a, "end": e, "base": own} for k, a, e, own in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, entry)], names=[id_col, "spans"])
    return src.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,"
                               "end:bigint,base:boolean>>")


def pii_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans as kind:start:end."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = personal_data(spark, docs, id_col, text_col).withColumn(
        "_base", F.filter("spans", lambda s: s["base"]))

    def of(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, *map(of, KINDS),
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
