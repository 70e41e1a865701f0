"""The patterns against regular expressions, the model against all segmentations, and recall."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from llm_fixtures import SF01, frame  # noqa: F401

from tessera.llm import pii as P

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def contract(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(IP, text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(CARD, text)
            if 13 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    out += [(3, m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return out


BITS = ["a", "Zed", "@", ".", "-", "+", "1", "255", "256", "0007", " ", "(", ")", "4111111111111111", "\n", "é",
        "10.0.0.1", "x.y@host.example.org", "+1 (323) 555-9830", "4111 1111 1111 1111", "%", "_", " at ", "[at]", ", ",
        "٣", "99"]


def test_patterns_match_regular_expressions():
    rng = random.Random(0)
    for _ in range(4000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))
        assert [(k, a, b) for k, a, b, holds in P.base_matches(t) if holds] == contract(t), t


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112") and P.luhn("79927398713")


@pytest.mark.parametrize("bad", ["a" * 300_000, "9" * 300_000, "1." * 150_000, "+1" + "." * 300_000, "a@" * 150_000,
                                 "@a." * 100_000, "1 2-3 4-" * 20_000])
def test_long_texts_stay_linear(bad):
    P.base_matches(bad)
    for isl in P.islands(bad):
        for _ in P.candidates(isl):
            pass


def segmentations(spans, at=0):
    """All sets of disjoint candidates, in order."""
    later = [(c, s) for c, s in enumerate(spans) if s[0] >= at]
    yield []
    for c, (a, b) in later:
        for rest in segmentations(spans, b):
            yield [c, *rest]


def score(spans, size, choice, kinds, scores, step):
    total, before, at = 0.0, 0, -1
    for c, k in zip(choice, kinds):
        a, b = spans[c]
        if a > at:
            total, before = total + step[before, 0], 0
        total += step[before, k + 1] + scores[c, k]
        before, at = k + 1, b
    return total + (step[before, 0] if at <= size else 0)


def every(spans, size, scores, step):
    from itertools import product
    for choice in segmentations(spans):
        for kinds in product(range(4), repeat=len(choice)):
            yield score(spans, size, choice, kinds, scores, step), choice, kinds


CARDS = [x for x in range(100) if P.luhn(f"41111111111111{x:02d}")]
TEXTS = ["x 123456 789-0123", "+1 555 1234", "1.2.3.456(789)012", "a1@b.co 99", "12 34 56 78", "9" * 30 + " 1234567"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("block", [1, 1024])
def test_decoding_and_expectations_are_exact(text, block, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(len(text))
    isl = P.Island(text, 0, "", "")
    spans = list(P.candidates(isl))
    for _ in range(4):
        step = rng.normal(size=(5, 5))
        step[0, 0] = 0
        m = P.Model(rng.normal(size=(P.BUCKETS, 4)), step)
        feats = np.array([P.features(isl, a, b) for a, b in spans]).reshape(len(spans), -1).astype(int)
        scores = m.span[feats].sum(axis=1)
        paths = list(every(spans, len(text), scores - 0.5, step))
        best = max(paths, key=lambda p: p[0])
        got = list(P.best_spans(isl, m, margin=0.5))
        assert got == [(k, *spans[c]) for c, k in zip(best[1], best[2])]
        if not spans:
            continue
        lat, _ = P.lattice(isl)
        z, share, _ = P.expectations(lat, scores, step)
        paths = list(every(spans, len(text), scores, step))
        total = math.log(sum(math.exp(p[0]) for p in paths))
        assert z == pytest.approx(total)
        want = np.zeros_like(share)
        for v, choice, kinds in paths:
            for c, k in zip(choice, kinds):
                want[c, k] += math.exp(v - total)
        assert np.allclose(share, want)


def test_change_counts_are_the_gradient():
    lat, _ = P.lattice(P.Island("x 123456 789-0123 +1 555 1234", 0, "", ""))
    rng = np.random.default_rng(1)
    scores, step = rng.normal(size=(len(lat.first), 4)), rng.normal(size=(5, 5))
    z, _, change = P.expectations(lat, scores, step)
    for i in range(5):
        for j in range(5):
            moved = step.copy()
            moved[i, j] += 1e-6
            assert (P.expectations(lat, scores, moved)[0] - z) / 1e-6 == pytest.approx(change[i, j], abs=1e-4)


def test_long_islands_decode_like_short_ones(monkeypatch):
    """One line of numbers: settled piece by piece, the result is that of one block."""
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10 ** rng.choice([3, 5, 8]))) for _ in range(800))
    m = P.Model(np.random.default_rng(2).normal(size=(P.BUCKETS, 4)) * 0.3, np.random.default_rng(3).normal(size=(5, 5)))
    m.step[0, 0] = 0
    isl = next(P.islands(text))
    whole = list(P.best_spans(isl, m))
    monkeypatch.setattr(P, "BLOCK", 40)
    assert list(P.best_spans(isl, m)) == whole and len(whole) > 20


def model(texts):
    found = {}
    for t in texts:
        for ex in P.examples_of(t):
            found[ex.lat.feats.tobytes()] = ex
    return P.train(list(found.values()))


def test_held_out_forms_are_found_and_plain_text_is_left_alone(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").collect()]
    m = model(texts[::2])
    hit = total = extra = 0
    for t in texts[1::2]:
        base, added = P.find(t, m)
        extra += len(added)
        for kind, a, b in base:
            for new in P.rewritten(kind, t[a:b]):
                changed = t[:a] + new + t[b:]
                one, more = P.find(changed, m)
                total += 1
                hit += (kind, a, a + len(new)) in one + more
    assert total > 40 and hit >= 0.9 * total
    assert extra <= 0.1 * total
    two = "call 4465758382889437 4465758382889437 now"
    assert P.find(two, m)[0] == [] and [two[a:b] for _, a, b in P.find(two, m)[1]] == ["4465758382889437"] * 2
    for plain in ("Version 2.0.", "in 2024-01-15 and 1999", "4465758382889438", "page 123456 of 7890123", "a, b (c) 12"):
        assert P.find(plain, m) == ([], []), plain


def test_report(frame, spark):
    rows = [(i, f"name.{i}@mail{i % 3}.example.com and 10.0.0.{i} é +1 (323) 555-{1000 + i} on 4111111111111111.", "x")
            for i in range(40)]
    rows += [(50, None, "x"), (51, "", None), (None, "9 4111111111111111", "x"), (3, rows[3][1], "x"),
             *[(100 + 9 * i + j, f"{'7 ' * (j % 2)}{w} 41111111111111{x:02d}{' on time' * (j % 3)}", "x")
               for i, x in enumerate(CARDS) for j, w in enumerate(["pay", "", "by", "with 9", "1", "a,", "=", "é", "5"])],
             (52, "call us on 4111111111111111 4111111111111111 é now", "x")]
    df = frame(rows, "doc_id long, text string, spans string")
    got = sorted(P.pii_report(spark, df).collect(), key=str)
    for (i, t, _), r in zip(sorted(rows, key=lambda x: str(x[0])), sorted(got, key=lambda r: str(r.doc_id))):
        assert r.doc_id == i
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r, want = by[i], contract(t or "")
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, _, _ in want) for j in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, joined.split(","))) <= set(spans)
        keys = [(P.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert keys == sorted(keys)
    assert len(got) == len(rows) and by[52].spans == "card:11:27,card:28:44"


def test_empty_tables(frame, spark):
    df = frame([(1, "text without any")], "doc_id long, text string")
    assert P.pii_report(spark, df.filter("false")).count() == 0
    assert P.pii_report(spark, df).first().spans == ""
