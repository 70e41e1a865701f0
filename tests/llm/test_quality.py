import random
import re
from fractions import Fraction
from math import comb

import pytest

from llm_fixtures import frame  # noqa: F401
from tessera.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(win) if win.count(w) > 1 for j in range(5)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            len(re.findall("[A-Z]", text)), lines)


CASES = ["", None, " \n\t", "a b c d e", "a b c d e a b c d e", "a " * 30, "Ünï cödé\x85x y #|$",
         "l one\nl one\n l one\n\n\nl one\r\nl two", "a b c d e f a b c d e g a b c d e f",
         "x y z w v x y z w v x y z w v q r s"]


def test_stats_match_definition():
    for t in CASES:
        assert Q.stats((t or "").encode()) == brute(t), t


def test_binomial_tail_is_exact():
    for k, n, p in [(0, 10, Fraction(1, 80)), (3, 500, Fraction(1, 80)), (499, 500, Fraction(1, 2)), (20, 20, Fraction(1, 3))]:
        exact = sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(min(k, n) + 1))
        assert Q.binomial_tail(k, n, float(p)) == pytest.approx(float(exact), rel=1e-9)


def test_choose_stops_at_first_risky_cutoff():
    n = len(Q.CUTOFFS)
    assert Q.choose([0] * n, list(range(n)), 10, 0.01, 0.01) is None  # too few good documents
    assert Q.choose([0] * 3 + [900] + [0] * (n - 4), list(range(1, n + 1)), 1000, 0.01, 0.01) == Q.CUTOFFS[2]
    assert Q.choose([0] * n, [0, 5, 5] + [5] * (n - 3), 1000, 0.01, 0.01) == Q.CUTOFFS[1]


def _docs():
    good = "word%d other%d thing%d more%d than%d ten%d words%d in%d every%d line%d of%d text%d"
    rows = [(i, good % ((i,) * 12), "en", "x") for i in range(700)]
    rows += [(1000 + i, (good % ((i,) * 12)).replace(" ", "### "), "en", "x") for i in range(40)]
    rows += [(2000 + i, (good % ((i,) * 12)).replace(" ", "### "), None, "x") for i in range(5)]
    rows += [(3000, None, "en", "x"), (3001, "too short", "fr", "x"), (None, good % ((1,) * 12), "en", "x")]
    labels = [(i, 1, 0) for i in range(700)] + [(1000 + i, 0, 0) for i in range(20)] + [
        (2000, 0, 0), (5, None, 0), (9999, 1, 0)]
    return rows, labels


def test_verdicts(frame, spark):
    rows, labels = _docs()
    docs = frame(rows, "doc_id long, text string, lang string, n_words string")
    lab = frame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality_verdicts(spark, docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(700)) and got[None].kept
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(40))
    assert all(got[2000 + i].kept for i in range(5))  # a stratum without labels of good documents
    assert got[3000].base_failed and got[3001].base_failed and not got[3000].kept
    kept = Q.keep_good(spark, docs, lab)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        k for k, r in got.items() if r.kept and k is not None)
    none = Q.quality_verdicts(spark, docs, lab.filter("false"))
    assert none.filter("kept = base_failed").count() == 0
    assert Q.quality_verdicts(spark, docs.filter("false"), lab).count() == 0


def test_false_rejection_is_within_risk(spark):
    """On the labelled fixture no stratum loses more than the risk of its good documents."""
    from llm_fixtures import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = Q.quality_verdicts(spark, docs, labels).join(labels, "doc_id").join(
        docs.select("doc_id", "lang"), "doc_id").filter("quality = 1 and not base_failed")
    for r in rows.groupBy("lang").agg({"*": "count", "kept": "max"}).collect():
        n = r["count(1)"]
        lost = rows.filter((rows.lang == r["lang"]) & ~rows.kept).count()
        assert lost <= 0.05 * n


def test_binomial_tail_of_many_documents_is_quick():
    import time
    start = time.time()
    assert Q.binomial_tail(5 * 10**7, 10**8, 0.5) == pytest.approx(0.5, abs=1e-3)
    assert Q.binomial_tail(4 * 10**6, 10**8, 0.05) < 1e-100 and Q.binomial_tail(6 * 10**6, 10**8, 0.05) == pytest.approx(1)
    assert time.time() - start < 5


def test_copies_are_one_observation(frame, spark):
    """A text that many labelled rows hold moves no cutoff more than once."""
    own = random.Random(3)
    text = lambda shout: " ".join(w.upper() if shout else w for w in (f"w{own.randrange(999)}" for _ in range(40)))
    rows = [(i, text(i % 4 == 0), "en", i % 4 != 0) for i in range(1600)]
    one = [(i, t, s) for i, t, s, _ in rows]
    copies = one + [(9000 + i, rows[1][1], "en") for i in range(300)]
    labels = [(i, int(g)) for i, _, _, g in rows] + [(9000 + i, 1) for i in range(300)]
    verdict = lambda docs: {r.doc_id: r.kept for r in Q.quality_verdicts(
        spark, frame(docs, "doc_id long, text string, lang string"), frame(labels, "doc_id long, quality int")).collect()}
    a, b = verdict(one), verdict(copies)
    assert {i: k for i, k in b.items() if i < 9000} == a and not all(a.values())
