import random

import numpy as np
import xxhash

from llm_fixtures import frame  # noqa: F401
from tessera.llm import simhash as S


def brute_fp(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    texts = ["", " \t\n", "one", "One two", "a b c", "A b\x0bc d É\xa0é x\x85y", "the the the the the",
             " ".join(str(i % 7) for i in range(500))]
    for t in texts:
        assert S.simhash(t.encode()) & (2**64 - 1) == brute_fp(t), t


def test_long_text_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    whole = S.simhash(text.encode())
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.simhash(text.encode()) == whole


def test_masks_cover_every_set_of_three_bits():
    masks = S.covering_masks(2**64 - 1, 3)
    assert len(masks) == 15
    miss = np.array([[not (m >> b & 1) for b in range(64)] for m in masks])
    for i in range(64):
        for j in range(i, 64):
            both = miss[:, i] & miss[:, j]
            assert (both[:, None] & miss).any(axis=0).all()


def test_levels_leave_few_free_bits():
    levels = S.mask_levels(3, 3)
    free = [max(64 - bin(m & (2**64 - 1)).count("1") for _, _, m in x) for x in levels]
    assert free == [32, 16, 8]


def test_components_match_brute_force(frame, spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    texts = {}
    for d in range(0, 60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        texts[d * 3] = " ".join(base)
        texts[d * 3 + 1] = " ".join(base)
        base[rng.randrange(len(base))] = "zzz"
        texts[d * 3 + 2] = " ".join(base).upper()
    texts |= {900: "", 901: None, 902: "\n \t"}
    df = frame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, fp string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id)
           for r in S.near_duplicates(spark, df).collect()}
    fps = {k: brute_fp(v) for k, v in texts.items()}
    want = brute_components(fps)
    assert got == {k: (fps[k], want[k]) for k in texts}


def test_dense_cluster_passes_all_levels(spark):
    """Hundreds of fingerprints within a few bits: buckets overflow and are dealt again."""
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center}
    for _ in range(250):
        x = center
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [S._signed(v) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for cap in (4, 512):
        e = S.links(spark, fps, 3, cap=cap)
        root = {r.node: r.root for r in S.connected_components(spark, e).collect()}
        want = brute_components({v: v & (2**64 - 1) for v in signed})
        assert {v: root.get(v, v) for v in signed} == want


def test_chain_components(spark):
    from tessera.llm.common import connected_components
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(spark, e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_repeated_null_and_empty(frame, spark):
    df = frame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u v"), (7, "x")],
               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (7, 7)], key=str)
    left = [r.doc_id for r in S.drop_near_duplicates(spark, df).collect()]
    assert sorted(left, key=str) == sorted([1, None, 7], key=str)
    none = S.near_duplicates(spark, df.filter("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "fingerprint", "component_id"]


def test_drop_keeps_a_row_of_every_component(frame, spark):
    """Null and repeated ids: rows of different components do not stand for each other."""
    rows = [(1, "a b c d", "x"), (5, "a b c d", "near copy"), (5, "only here q r s", "y"),
            (5, "only here q r s", "z"), (None, "a b c d", "near copy"), (None, "first of none f g h", "x"),
            (None, "second of none k l m", "x"), (None, "second of none k l m", "y"), (7, "p o i u", "x"),
            (7, "t r e w", "x"), (2, "t r e w", "x"), (9, None, "x"), (None, "", "x")]
    want = [(1, "a b c d"), (2, "t r e w"), (5, "only here q r s"), (7, "p o i u"), (9, None),
            (None, "first of none f g h"), (None, "second of none k l m")]
    runs = []
    for parts in (1, 4):
        df = frame(rows, "doc_id long, text string, source string", parts)
        left = [tuple(r) for r in S.drop_near_duplicates(spark, df).collect()]
        assert sorted((r[:2] for r in left), key=str) == sorted(want, key=str)
        runs.append(sorted(left, key=str))
    assert runs[0] == runs[1]


def test_rows_that_differ_in_the_place_of_a_null(frame, spark):
    """Equal values in other columns are other rows; clashing names stay."""
    rows = [(1, "en", None, "k"), (1, None, "en", "k"), (2, "en", "en", None)]
    df = frame(rows, "doc_id long, text string, lang string, _k0 string")
    left = S.drop_near_duplicates(spark, df)
    assert left.columns == df.columns
    # 'en' is the text of two rows; a null text has the zero fingerprint and is its own component.
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[1]], key=str)
