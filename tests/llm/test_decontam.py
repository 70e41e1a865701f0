import random

import numpy as np
from llm_fixtures import frame  # noqa: F401

from tessera.llm import decontam as D

rng = random.Random(11)
COMMON = ["the", "of", "and", "to", "in", "is"]
WORDS = ["w%d" % i for i in range(3000)]


def prose(n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n)]


ITEMS = {i: prose(rng.randint(12, 58)) for i in range(40)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_lcs_matches_table():
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert D.lcs_length(D._masks(a), len(a), b) == lcs(a, b)


def test_answer():
    assert D.answer_of(b"What is it? Answer: forty two") == b" forty two"
    assert D.answer_of(b"One thing. Two things!\nThree.") == b"Three."
    assert D.answer_of(b"") == b""


def corpus():
    docs, leaks = [], set()
    for d in range(400):
        words = prose(rng.randint(5, 300))
        if d % 4 == 0:
            item = rng.randrange(40)
            hurt = [w for w in ITEMS[item] if rng.random() > 0.1 * (d % 8 == 0)]
            at = rng.randint(0, len(words))
            words = words[:at] + hurt + words[at:]
            leaks.add((d, item))
        docs.append((d, " ".join(words).title() if d % 3 else "\n".join(words), "x"))
    return docs, leaks


def tables(frame):
    docs, leaks = corpus()
    docs += [(900, None, "x"), (901, "", "x"), (902, "the of and", "x")]
    return (frame(docs, "doc_id long, text string, lcs string"),
            frame([(i, " ".join(w) + ".") for i, w in ITEMS.items()] + [(77, None), (78, " ")],
                  "item_id long, text string"), leaks)


def test_planted_leaks_are_found_and_clean_documents_kept(frame, spark):
    docs, bench, leaks = tables(frame)
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(spark, docs, bench).collect()}
    assert len(leaks - set(got)) <= 0.05 * len(leaks)
    assert set(got) <= leaks
    for (d, i), r in got.items():
        assert r.lcs >= 0.6 and r.cosine >= 0.3
    left = {r.doc_id for r in D.drop_leaks(spark, docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def anywhere(item, need, words):
    """The longest common subsequence with any part of ``words`` up to three times as long."""
    ok = max(8, 1 << (len(item) - 1).bit_length()) * 3 // 2
    return any(lcs(item, words[a:a + ok]) >= need for a in range(0, max(1, len(words) - ok // 3), 2))


def test_recall_against_all_word_positions(frame, spark, monkeypatch):
    """More items than the rank and more documents than the fit; paraphrases keep 65 to 80 % of
    the words, content words replaced.  The truth is the subsequence at every place of a text."""
    monkeypatch.setattr(D, "FIT_DOCUMENTS", 150)
    own = random.Random(21)

    def text(n):
        return [own.choice(COMMON) if own.random() < 0.4 else own.choice(WORDS) for _ in range(n)]
    items = {i: [text(own.randint(8, 25)), text(own.randint(6, 12))] for i in range(150)}
    docs = [(d, text(own.randint(20, 150))) for d in range(300, 500)]
    for d in range(300):
        first, last = items[own.randrange(150)]
        words = list(first)
        content = [k for k, w in enumerate(words) if w not in COMMON]
        for k in own.sample(content, min(len(content), int(own.uniform(0.2, 0.35) * len(first + last)))):
            words[k] = "zz%d" % own.randrange(10**6)
        docs.append((d, text(own.randint(0, 60)) + words + last + text(own.randint(0, 60))))
    bench = frame([(i, " ".join(a) + ". " + " ".join(b) + ".") for i, (a, b) in items.items()],
                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(
        spark, frame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), bench).collect()}
    truth = set()
    for d, words in docs:
        have = set(words)
        for i, (a, b) in items.items():
            item = a + b
            content = [w for w in b if w not in COMMON] if sum(w not in COMMON for w in b) >= 3 else None
            need = D.need_of(len(item), D.Params())
            if sum(w in have for w in item) >= need and anywhere(item, need, words) and (
                    content is None or anywhere(content, -(-len(content) // 2), words)):
                truth.add((d, i))
    print("recall", len(got & truth) / len(truth), "extra", len(got - truth))
    assert len(truth) > 200 and len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(truth)


def test_other_ids_and_clashing_names(frame, spark):
    docs, bench, leaks = tables(frame)
    named = docs.selectExpr("concat('d', doc_id) AS item_id", "text", "lcs")
    got = D.find_leaks(spark, named, bench.selectExpr("concat('i', item_id) AS item_id", "text"), id_col="item_id")
    assert got.columns == ["item_id", "_item_id", "lcs", "cosine", "first_word", "end_word"]
    found = {(int(r.item_id[1:]), int(r._item_id[1:])) for r in got.collect()}
    assert len(leaks - found) <= 0.05 * len(leaks)


def test_blocks_of_items_find_the_same(frame, spark, monkeypatch):
    docs, bench, leaks = tables(frame)
    bench = bench.unionByName(bench.filter("item_id < 3")).unionByName(  # repeated rows and ids
        bench.filter("item_id in (3, 4)").selectExpr("item_id + 1 AS item_id", "text"))
    key = lambda r: tuple(r)
    one = sorted(D.find_leaks(spark, docs, bench).collect(), key=key)
    monkeypatch.setattr(D, "BLOCK_WORDS", 150)
    assert sorted(D.find_leaks(spark, docs, bench).collect(), key=key) == one
    got = {(r.doc_id, r.item_id) for r in one}
    assert len(leaks - got) <= 0.05 * len(leaks)
    twice = [(r.doc_id, r.item_id) for r in one if r.item_id < 3]
    assert len(twice) == 2 * len(set(twice)) > 0


def test_distributed_product_is_exact(spark):
    texts = spark.createDataFrame([(b"a b c a",), (b"c z b",), (b"",), (b"z",)], "t binary").repartition(2)
    vocab, weight = {b"a": 0, b"b": 1, b"c": 2}, np.array([1.0, 2.0, 3.0])
    x = np.random.default_rng(0).normal(size=(3, 2))
    rows = np.array([[2.0, 2, 3, 0], [0, 2, 3, 5], [0, 2, 0, 0]])
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True))[:, :3]
    got = D.gram_product(texts, [np.array([1])], vocab, weight, 5.0, x)
    assert np.allclose(got, rows.T @ (rows @ x))


def test_paraphrase_needs_its_answer():
    p = D.Params()
    item = D.Item(1, list(range(20)), [16, 17, 18, 19], 2)
    check = lambda passage: D.verify(item, D._masks(item.words), passage, p)
    assert check(list(range(14))) == 0  # 70 % without the answer
    assert check(list(range(12)) + [16, 17]) == 0.7
    assert check(list(range(16))) == 0.8
    assert check(list(range(11))) == 0


def test_what_counts_as_an_answer():
    words = {w: i for i, w in enumerate([b"the", b"of", b"paris", b"lyon", b"capital", b"river", b"answer", b"is"])}
    space = D.Space(words, np.array([90, 80, 1, 1, 2, 2, 1, 50]), np.zeros((9, 2)), 100)
    assert D.answer_terms(b"the capital. Answer: the river of", space) == ([0, 5, 1], 2)
    assert D.answer_terms(b"the capital. is the paris, lyon river!", space) == ([2, 3, 5], 2)
    assert D.answer_terms(b"the capital of paris lyon. the river", space) == ([4, 2, 3, 5], 2)  # too short
    assert D.answer_terms(b"the capital is paris lyon river.", space) == ([4, 2, 3, 5], 2)  # one sentence
    assert D.answer_terms(b"the of", space) == ([], 0)


def test_bounds_lose_no_window():
    """Every window whose longest common subsequence suffices is among those of the index."""
    own = random.Random(8)
    vocab = {b"w%d" % i: i for i in range(60)}
    space = D.Space(vocab, np.array([own.randrange(50) for _ in vocab]), np.ones((61, 2), np.float32), 50)
    p, seen = D.Params(), 0
    for _ in range(150):
        items = [(k, b" ".join(b"w%d" % own.randrange(60) for _ in range(own.randint(1, 25)))) for k in range(6)]
        m = D.model_of(items, space, p)
        parts = [own.choice(items)[1].split() if own.random() < 0.3 else
                 [b"w%d" % own.randrange(80)] for _ in range(own.randint(0, 30))]
        text = b" ".join(w for part in parts for w in part if own.random() < 0.85)
        ids = D.word_ids(text, vocab)
        if not len(ids):
            continue
        got = set(zip(*(a.tolist() for a in D.windows(ids, m))))
        for i, item in enumerate(m.items):
            stride = int(m.stride[i])
            for start in range(0, max(1, len(ids) - 3 * stride + stride), stride):
                if lcs(item.words, ids[start:start + 3 * stride].tolist()) >= D.need_of(len(item.words), p):
                    seen += 1
                    assert (i, start) in got
    assert seen > 100


def test_empty_tables(frame, spark):
    docs, bench, _ = tables(frame)
    assert D.find_leaks(spark, docs.filter("false"), bench).count() == 0
    assert D.find_leaks(spark, docs, bench.filter("false")).count() == 0
    assert D.drop_leaks(spark, docs, bench.filter("false")).count() == docs.count()


def test_paraphrases_without_rare_words_are_found(frame, spark):
    """The rarest words replaced, 75 % of all kept in order with the answer: a leak by its LCS."""
    own = random.Random(3)
    docs, leaks = [(1000 + d, " ".join(prose(120))) for d in range(200)], set()
    for d, (i, words) in enumerate(ITEMS.items()):
        rare = [k for k, w in enumerate(words) if w not in COMMON][:len(words) // 4]
        changed = ["zz%d" % own.randrange(10**6) if k in rare else w for k, w in enumerate(words)]
        docs.append((d, " ".join(prose(30) + changed + prose(30))))
        share = lcs(words, changed) / len(words)
        answer = D.plain_words(D.answer_of(" ".join(words).encode()))
        if share >= 0.6 and 2 * lcs(answer, [w.encode() for w in changed]) >= len(answer):
            leaks.add((d, i))
    bench = frame([(i, " ".join(w) + ".") for i, w in ITEMS.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(
        spark, frame(docs, "doc_id long, text string"), bench).collect()}
    assert len(leaks) == 40 and len(got & leaks) >= 0.95 * len(leaks) and got <= leaks


def test_terms_and_space_come_from_all_documents(frame, spark, monkeypatch):
    """Words and passages of every row count, however few rows a task holds at once."""
    monkeypatch.setattr(D, "FIT_DOCUMENTS", 7)
    monkeypatch.setattr(D, "FIT_TERMS", 150)
    own = random.Random(5)
    texts = [" ".join("W%d" % int(own.random() ** 2 * 400) for _ in range(own.randint(0, 130))) for _ in range(300)]
    items = [" ".join("w%d" % own.randrange(500) for _ in range(20)) for _ in range(5)]
    space = D._search(spark, frame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string"),
                      frame(list(enumerate(items)), "item_id long, text string"),
                      "doc_id", "text", "item_id", "text", D.Params(rank=4))[1][0].space
    rows = [t.lower().encode().split() for t in texts]
    held = np.unique([w for r in rows for w in set(r)], return_counts=True)
    counts = dict(zip(held[0].tolist(), held[1].tolist()))
    often = sorted(counts, key=lambda w: (-counts[w], w))[:150]
    assert set(space.vocab) == {w for t in items for w in t.encode().split()} | set(often) and space.n_docs == 301
    assert [counts.get(w, 0) for w in space.vocab] == space.df.tolist()
    weight, other = np.maximum(np.log(302 / (space.df + 1)), 0.01), np.log(302)
    a = []
    for words in [r[k:k + 48] for r in rows for k in range(0, len(r), 48)] + [t.encode().split() for t in items]:
        row, missing = np.zeros(len(weight)), 0
        for w in words:
            if w in space.vocab:
                row[space.vocab[w]] += weight[space.vocab[w]]
            else:
                missing += 1
        a.append(row / max(np.sqrt(row @ row + missing * other ** 2), 1e-12))
    a = np.array(a)
    x = np.linalg.qr(np.random.default_rng(1).standard_normal((len(weight), 12)))[0]
    x = np.linalg.qr(a.T @ (a @ x))[0]
    values, vectors = np.linalg.eigh(x.T @ a.T @ (a @ x))
    want = weight[:, None] * (x @ vectors[:, np.argsort(-values)[:4]])
    assert np.allclose(np.abs(space.fold[:-1]), np.abs(want), atol=1e-3)
