"""Scripts of edits against one splice after another."""

import random

from tessera.streaming import pieces as P
from tessera.streaming.edits import fold_edits

SCHEMA = "doc long, seq long, beg long, end long, new_text string"


def splice(text, beg, end, new):
    return text[:beg] + new + text[end:]


def made(own, size, n):
    return [(b := own.randrange(0, size + 6), b + own.choice([0, 0, 1, 3, 9, -1 if b else 0]), own.choice([b"", b"x", b"yz1", "é".encode()]))
            for _ in range(n)]


def test_scripts_compose():
    own = random.Random(1)
    for _ in range(300):
        text = bytes(own.randrange(97, 123) for _ in range(own.randrange(0, 12)))
        edits, want, sizes = made(own, 12, own.randrange(1, 12)), text, [len(text)]
        for e in edits:
            want = splice(want, *e)
            sizes.append(len(want))
        run = lambda s: b"".join((text if o else s[1])[a:a + n] for o, a, n in s[0])
        assert run(P.edited(len(text), edits)) == want
        a, b = sorted((own.randrange(len(edits) + 1), own.randrange(len(edits) + 1)))
        one, two, three = (P.edited(sizes[i], edits[i:j]) for i, j in ((0, a), (a, b), (b, len(edits))))
        left, right = P.compose(P.compose(one, two), three), P.compose(one, P.compose(two, three))
        assert run(left) == run(right) == want and left == right


def test_equals_the_fold(spark):
    own = random.Random(2)
    rows = [(doc, i, b, max(e, 0), t.decode()) for doc in range(6) for i, (b, e, t) in enumerate(made(own, 30, 5 + 60 * doc))]
    edits = spark.createDataFrame(rows, SCHEMA).repartition(4)
    base = spark.createDataFrame([(d, bytearray(b"base text of a document")) for d in (1, 2, 5)], "doc long, bin binary")
    for b in (None, base):
        want = {r.doc: (bytes(r.bin), r.n_edits, r.last_seq) for r in fold_edits(edits, "doc", b).collect()}
        got = {r.doc: (bytes(r.bin), r.n_edits, r.last_seq) for r in P.fold_many(edits, "doc", b, chunk=7, fan=3).collect()}
        assert got == want and len(want) == 6


def test_one_document_of_many_edits(spark):
    """A hundred thousand edits of one document, over many tasks."""
    n = 100_000
    edits = spark.range(n).selectExpr("1L AS doc", "id AS seq", "id AS beg", "id AS end", "cast(id % 10 AS string) AS new_text")
    r = P.fold_many(edits, "doc").collect()
    assert bytes(r[0].bin) == b"0123456789" * (n // 10) and r[0].n_edits == n


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, None), (1, 1, 5, None, "a"), (None, 0, -3, 0, "b")], SCHEMA)
    assert {r.doc: bytes(r.bin) for r in P.fold_many(df, "doc").collect()} == {1: b"a", None: b"b"}
    assert P.fold_many(df.filter("false"), "doc").count() == 0
