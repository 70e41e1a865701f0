"""Secret scan with one combined deterministic automaton.

Rules are small trees of bytes.  All rules together become one nondeterministic
automaton that may start a match anywhere, then by subset construction and minimisation
one table of transitions: a text is scanned once, a table look-up per byte, for all
rules.  The pass tells which rules match somewhere in a text (it ends a match at the
first byte that completes one, so runs need no states).  Only for those, a reversed
automaton of the rule marks where its matches start, and a forward one runs from the
leftmost start to the longest end, non-overlapping.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts


def chars(spec: str) -> tuple:
    """One byte of a class such as ``A-Z0-9_``; a hyphen that starts or ends it is itself."""
    return ("set", frozenset(b for b in range(256) if re.fullmatch(f"[{spec}]", chr(b)) and b < 128))


def word(text: str, fold: bool = False) -> tuple:
    """The bytes of ``text``; with ``fold`` ASCII letters in either case."""
    return seq(*[("set", frozenset({ord(c), *((ord(c.lower()), ord(c.upper())) if fold else ())}))
                 for c in text])


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def opt(part: tuple) -> tuple:
    return ("opt", part)


def star(part: tuple) -> tuple:
    return ("star", part)


def plus(part: tuple, least: int = 1) -> tuple:
    return seq(*[part] * least, star(part))


class Rule(NamedTuple):
    """kind; head and value (a match is head then value); least bytes of match and value.
    ``value`` must not be able to start inside ``head`` in two ways."""
    kind: str
    head: tuple
    value: tuple
    min_match: int = 0
    min_value: int = 0


_ALNUM = "A-Za-z0-9"
_QUOTE = opt(chars("\"'"))
_KEY = alt(*[word(w, True) for w in ("password", "passwd", "secret", "token")],
           seq(word("api", True), opt(word("_")), word("key", True)))
_SPACES = star(word(" "))

#: The first three are the base rules; the others are public formats of access tokens.
RULES = (
    Rule("assign", seq(_KEY, _QUOTE, _SPACES, chars(":="), _SPACES, _QUOTE),
         plus(chars(_ALNUM + "+/_.=-")), 0, 12),
    Rule("access", word("AKIA"), plus(chars("A-Z0-9")), 18),
    Rule("hex", seq(), plus(chars("0-9a-f"), 16), 16),
    Rule("github", seq(word("gh"), chars("pousr"), word("_")), plus(chars(_ALNUM)), 40),
    Rule("slack", seq(word("xox"), chars("abprs"), word("-")), plus(chars(_ALNUM + "-")), 15),
    Rule("google", word("AIza"), plus(chars(_ALNUM + "_-")), 39),
    Rule("stripe", seq(alt(word("sk"), word("rk")), word("_live_")), plus(chars(_ALNUM)), 24),
    Rule("pem", word("-----BEGIN "), seq(star(chars("A-Z ")), word("PRIVATE KEY-----"))),
    Rule("jwt", seq(word("eyJ"), plus(chars(_ALNUM + "_-")), word(".eyJ"),
                    plus(chars(_ALNUM + "_-")), word(".")), plus(chars(_ALNUM + "_-")), 40),
)
BASE = ("assign", "access", "hex")


def pattern(tree: tuple) -> bytes:
    """The tree as a bytes regular expression."""
    kind, body = tree
    if kind == "set":
        return b"[" + b"".join(b"\\x%02x" % c for c in sorted(body)) + b"]"
    if kind == "seq":
        return b"".join(pattern(p) for p in body)
    if kind == "alt":
        return b"(?:" + b"|".join(pattern(p) for p in body) + b")"
    return b"(?:" + pattern(body) + (b")?" if kind == "opt" else b")*")


def reverse(tree: tuple) -> tuple:
    kind, body = tree
    if kind == "seq":
        return ("seq", tuple(reverse(p) for p in reversed(body)))
    if kind == "alt":
        return ("alt", tuple(reverse(p) for p in body))
    return tree if kind == "set" else (kind, reverse(body))


def shortest(tree: tuple) -> tuple:
    """The tree without what it may lack at its end: matches somewhere just where it does."""
    kind, body = tree
    if kind != "seq":
        return tree
    parts = list(body)
    while parts and parts[-1][0] in ("star", "opt"):
        parts.pop()
    return ("seq", (*parts[:-1], shortest(parts[-1]))) if parts else ("seq", ())


class Dfa(NamedTuple):
    """Transition arrays: ``step[state * 256 + byte]`` is the next state times 256.
    States from ``accept`` on accept; ``rules[state // 256]`` is the bit set of rules."""
    step: np.ndarray
    start: int
    accept: int
    rules: np.ndarray
    dead: int


def _nfa(trees: tuple) -> tuple[list, list, list, dict]:
    eps: list[list[int]] = []
    edge: list[tuple | None] = []

    def new() -> int:
        eps.append([])
        edge.append(None)
        return len(eps) - 1

    def build(tree: tuple, at: int) -> int:
        """Adds ``tree`` from state ``at``; returns its end state."""
        kind, body = tree
        if kind == "set":
            end = new()
            edge[at] = (body, end)
            return end
        if kind == "seq":
            for part in body:
                at = build(part, at)
            nxt = new()
            eps[at].append(nxt)
            return nxt
        end = new()
        if kind == "alt":
            for part in body:
                begin = new()
                eps[at].append(begin)
                eps[build(part, begin)].append(end)
            return end
        begin = new()
        eps[at] += [begin, end]
        eps[build(body, begin)].append(begin if kind == "star" else end)
        if kind == "star":
            eps[begin].append(end)
        return end

    starts, final = [], {}
    for i, tree in enumerate(trees):
        starts.append(new())
        body = new()
        eps[starts[-1]].append(body)
        final[build(tree, body)] = 1 << i
    return eps, edge, starts, final


def compile_dfa(trees: tuple, anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation by partition refinement."""
    eps, edge, starts, final = _nfa(trees)
    sets = {e[0] for e in edge if e}
    classes: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    of_byte = np.array([classes.setdefault(tuple(b in s for s in ordered), len(classes))
                        for b in range(256)])
    sample = [int(np.argmax(of_byte == c)) for c in range(len(classes))]

    def closure(states: frozenset) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for n in eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(s for s in seen if edge[s] or s in final)

    first = closure(frozenset(starts))
    index, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for b in sample:
            moved = frozenset(edge[s][1] for s in state if edge[s] and b in edge[s][0])
            nxt = closure(moved) | (first if anywhere else frozenset())
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    step = np.array(rows)
    marks = np.array([sum({final[s] for s in state if s in final}) for state in order])
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    firsts = np.unique(part, return_index=True)[1]
    # Accepting states last, so that one comparison tells them.
    rank = np.argsort(np.argsort(marks[firsts] > 0, kind="stable"), kind="stable")
    small = np.empty((len(firsts), len(sample)), np.int64)
    small[rank] = rank[part[step[firsts]]]
    rules = np.empty(len(firsts), np.int64)
    rules[rank] = marks[firsts]
    loops = [s for s in range(len(firsts)) if not rules[s] and (small[s] == s).all()]
    return Dfa((small[:, of_byte] * 256).ravel(), int(rank[part[0]]) * 256,
               int((rules == 0).sum()) * 256, rules, loops[0] * 256 if loops else -1)


class Scanner:
    """The compiled rules; transition arrays as lists, which Python indexes fastest."""

    def __init__(self, rules: tuple = RULES):
        whole = [seq(r.head, r.value) for r in rules]
        self.rules = rules
        self.all = compile_dfa(tuple(shortest(t) for t in whole), True)
        self.table = self.all.step.tolist()
        self.forward = [compile_dfa((t,), False) for t in whole]
        self.forward_table = [d.step.tolist() for d in self.forward]
        self.backward = [compile_dfa((reverse(t),), True) for t in whole]
        self.backward_table = [d.step.tolist() for d in self.backward]
        self.parts = [re.compile(pattern(r.head) + b"(" + pattern(r.value) + b")") for r in rules]

    def matching(self, data: bytes) -> list[int]:
        """Rules that match somewhere in ``data``: the one pass over all bytes."""
        table, accept, s, hit = self.table, self.all.accept, self.all.start, set()
        for b in data:
            s = table[s + b]
            if s >= accept:
                hit.add(s)
        mask = 0
        for state in hit:
            mask |= int(self.all.rules[state // 256])
        return [i for i in range(len(self.rules)) if mask >> i & 1]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: leftmost, longest, non-overlapping per rule; matches
        below the rule's least lengths are dropped after they took their bytes."""
        found = []
        for i in self.matching(data):
            dfa, table, s = self.backward[i], self.backward_table[i], self.backward[i].start
            starts = []
            for at in range(len(data) - 1, -1, -1):
                s = table[s + data[at]]
                if s >= dfa.accept:
                    starts.append(at)
            dfa, table, end = self.forward[i], self.forward_table[i], 0
            for start in reversed(starts):
                if start < end:
                    continue
                s = dfa.start
                for at in range(start, len(data)):
                    s = table[s + data[at]]
                    if s >= dfa.accept:
                        end = at + 1
                    elif s == dfa.dead:
                        break
                rule = self.rules[i]
                if end - start >= rule.min_match and (
                        not rule.min_value or
                        len(self.parts[i].fullmatch(data, start, end)[1]) >= rule.min_value):
                    found.append((start, i, end))
        return sorted(found)


@lru_cache(maxsize=2)
def scanner(rules: tuple) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


_CONTINUATION = bytes(range(0x80, 0xC0))


def scan(data: bytes, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the rules' order."""
    spans = scanner(rules).spans(data)
    edges = sorted({x for s, _, e in spans for x in (s, e)})
    at, points, before = 0, 0, {}
    for x in edges:
        points += len(data[at:x].translate(None, _CONTINUATION))
        before[x], at = points, x
    return [(rules[i].kind, before[s], before[e]) for s, i, e in spans]


def _digest(data: bytes) -> tuple:
    found = scan(data)
    joined = [(k, f"{k}:{s}:{e}") for k, s, e in found]
    base = ",".join(x for k, x in joined if k in BASE)
    return (*(sum(k == b for k, _ in joined) for b in BASE),
            hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in joined))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans (base_sha256 is that of the empty string); repeated
    rows each return; an empty table returns none; other columns are ignored.  A text is
    scanned whole, however long; memory is that of one Arrow batch and the tables."""
    src = docs.select(docs[id_col], docs[text_col].alias("_t"))
    return map_texts(src, [id_col], "_t", _digest,
                     "n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
                     [pa.int64()] * 3 + [pa.string()] * 2)
