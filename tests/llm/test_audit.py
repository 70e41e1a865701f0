"""The audit against a run of every order over every document, and against DuckDB."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
from llm_fixtures import frame  # noqa: F401

from tessera.llm import audit as A
from tessera.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Row by row: the set of failed filters."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
             "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        out.append({k for k, v in f.items() if v})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    sets, out, shap = fails(rows), {}, Counter()
    parts = {r[2] or "" for r in rows}
    for order in permutations("ABCDE"):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            gone = [k for k in left if f in sets[k]]
            left = [k for k in left if f not in sets[k]]
            for p in parts:
                mine = [k for k in range(len(rows)) if (rows[k][2] or "") == p]
                g = [k for k in gone if k in set(mine)]
                shap[p, f] += len(g)
                bad = [k for k in mine if f in sets[k]]
                out[p, "".join(order), step] = [
                    len([k for k in left if k in set(mine)]), len(g),
                    len([k for k in bad if sets[k] & set(order[:step - 1])]),
                    len([k for k in mine if sets[k] == {f}]),
                    len([k for k in g if rows[k][0] in good]), len([k for k in g if rows[k][0] in toxic])]
    return {(p, o, s): tuple(v + [shap[p, o[s - 1]]]) for (p, o, s), v in out.items()}


def corpus():
    rng = random.Random(6)
    kinds = [lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n)),
             lambda n: " ".join(rng.choice(["a", "b", "É", "the"]) for _ in range(n)),
             lambda n: " ".join(rng.choice(["LOUD", "TEXT%d" % rng.randrange(999)]) for _ in range(n)),
             lambda n: "\t".join("#%d" % rng.randrange(99) for _ in range(n))]
    rows = [(i, rng.choice(kinds)(rng.choice([0, 3, 99, 100, 130])), rng.choice(["en", "de", "", None]))
            for i in range(60)]
    rows += [(60 + i, rows[rng.randrange(40)][1], "en") for i in range(20)]
    rows += [(200, None, "en"), (201, "", None), (None, "no id", "en"), (None, rows[0][1], "de"),
             (70, rows[70][1], "en"), (202, "word " * 5000, "de"), (203, "\x1c \x85x   y", "en"),
             (204, "A" + "é" * 9, "en"), (205, "A" + "é" * 10, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 210, 2)] + [
        (None, 1, 1), (4, 1, 0), (4, 0, 1), (6, None, None), (999, 1, 1)]
    return rows, labels


def collect(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in rows}
    assert len(out) == len(rows)
    return out


def tables(frame):
    rows, labels = corpus()
    docs = frame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, part string, "
                 "row_id int, step int", 4)
    return rows, labels, docs, frame(labels, "doc_id long, quality int, toxic int")


def test_all_orders_match_brute_force(frame, spark, monkeypatch):
    rows, labels, docs, marks = tables(frame)
    want = brute(rows, labels)
    assert collect(A.audit(spark, docs, marks)) == want
    monkeypatch.setattr(A, "SHARD_BYTES", 1500)
    assert collect(A.audit(spark, docs, marks)) == want


def test_matches_its_sql(frame, spark):
    rows, labels, docs, marks = tables(frame)
    documents, label = docs.toPandas(), marks.toPandas()
    con = duckdb.connect()
    con.register("documents", documents.assign(doc_id=documents.doc_id.astype("Int64")))
    con.register("labels", label.astype("Int64"))
    cur = con.execute(ORACLES["op11_filter_audit"])
    names = [d[0] for d in cur.description]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
        for r in (dict(zip(names, x)) for x in cur.fetchall())}
    # SQL's regular expressions cut words at ASCII white space alone, as the operator does.
    assert got == collect(A.audit(spark, docs, marks))


def test_matrix_counts_every_word(frame, spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_BYTES", 900)
    monkeypatch.setattr(A, "BUCKETS", 7)
    rows, _, docs, _ = tables(frame)
    m = A.document_term_matrix(spark, docs.select("doc_id", "text"), ["doc_id"], "text")
    words = {r.term: r.word for r in m.dictionary.collect()}
    every = Counter(w for _, t, _ in rows for w in WORD.findall(t or ""))
    assert sorted(words.values()) == sorted(every)
    per_bucket = Counter(k % 7 for k in words)
    assert all(k // 7 < per_bucket[k % 7] for k in words)  # dense within buckets
    got, by_row = Counter(), {}
    for r in m.shards.collect():
        indptr, indices, counts = A.unpack(bytes(r.matrix))
        assert len(indptr) == len(r.doc_id) + 1 and indptr[-1] == len(indices)
        terms = dict(map(tuple, r.numbers or []))
        for i, n in zip(indices.tolist(), counts.tolist()):
            got[words[terms[i]]] += n
    assert got == every


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for entries in (0, 1, 500):
        cuts = np.sort(rng.integers(0, entries + 1, 9))
        indptr = np.concatenate([[0], cuts, [entries]]).astype(np.int32)
        indices = np.concatenate([np.sort(rng.permutation(10**6)[:n]) for n in np.diff(indptr)]).astype(np.int32)
        counts = rng.integers(1, 2**31 - 1, entries).astype(np.int32)
        p, i, c = A.unpack(A.pack(indptr, indices, counts))
        assert (p == indptr).all()
        assert (i == indices).all() and (c == counts).all()


def test_orders_are_all():
    class Frame:
        def createDataFrame(self, rows, _):
            return rows
    rows = A.orders(Frame())
    assert len(rows) == 600 and len({r[0] for r in rows}) == 120
    for order, step, own, before in rows:
        assert own == 1 << "ABCDE".index(order[step - 1])
        assert before == int(np.sum([1 << "ABCDE".index(c) for c in order[:step - 1]]))


def test_empty_tables(frame, spark):
    _, _, docs, marks = tables(frame)
    assert A.audit(spark, docs.filter("false"), marks).count() == 0
    got = collect(A.audit(spark, docs.filter("doc_id = 200"), marks.filter("false")))
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_words_are_cut_in_pieces_with_the_same_counts(monkeypatch):
    texts = pa.array(["b a b", "", " a  c", "c" * 40, None, "a b"] * 5)
    whole = A.count_words(texts.fill_null(""))
    monkeypatch.setattr(A, "CUT_BYTES", 7)
    cut = []
    split = A.pc.ascii_split_whitespace
    monkeypatch.setattr(A.pc, "ascii_split_whitespace", lambda t: cut.append(len(t)) or split(t))
    pieces = A.count_words(texts.fill_null(""))
    assert len(cut) > 5
    assert whole[0].to_pylist() == pieces[0].to_pylist() == ["b", "a", "c", "c" * 40]
    assert all(np.array_equal(x, y) for x, y in zip(whole[1:], pieces[1:], strict=True))
    assert A.count_words(pa.array([], pa.string()))[1].tolist() == [0]


def test_salted_copies_are_not_broadcast(spark):
    """The planner takes the few bytes of the file for the size of sixteen copies of its rows."""
    from tessera.llm.common import salted_join
    big = spark.createDataFrame([(k % 3, k) for k in range(9)], "k long, n long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    joined = salted_join(big, small, ["k"], "left", ["n"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.k, r.n, r.v) for r in joined.collect()) == sorted((k % 3, k, {0: "a", 1: "b"}.get(k % 3)) for k in range(9))
