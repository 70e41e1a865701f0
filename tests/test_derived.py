"""State kept by deltas against a rebuild, batch by batch."""

import random
import re
from collections import Counter

from tessera.plans.edits import _word_occurrences
from tessera.streaming import derived as D

SCHEMA = "key string, pkg string, text string"
WORDS = ["Alpha", "alpha", "Beta", "beta", "Gamma", "gamma", "delta", "Delta", "eps"]


def rebuild(files):
    index, diags = Counter(), Counter()
    for key, (pkg, text) in files.items():
        seen = set()
        for w in re.findall("[A-Za-z]+", text):
            name, decl = w.lower(), w[0].isupper()
            index[pkg, name, "n_decl" if decl else "n_ref"] += 1
            seen.add(name)
        for name in seen:
            index[pkg, name, "n_files"] += 1
    for key, (pkg, text) in files.items():
        for w in re.findall("[a-z]+", " ".join(x for x in re.findall("[A-Za-z]+", text) if x[0].islower())):
            if not index[pkg, w, "n_decl"]:
                diags[key, w] += 1
    names = {(p, n) for p, n, _ in index}
    return ({(p, n): tuple(index[p, n, c] for c in ("n_decl", "n_ref", "n_files")) for p, n in names}, dict(diags))


def state(spark, path, batches):
    index = {(r.pkg, r.name): (r.n_decl, r.n_ref, r.n_files) for r in D.symbol_state(spark, path, batches).collect()}
    rows = D.diagnostics_state(spark, path, batches).collect()
    diags = {(r.key, r.name): r.n for r in rows}
    assert len(diags) == len(rows)
    return index, diags


def test_deltas_equal_a_rebuild(spark, scratch):
    own = random.Random(2)
    files, path, done = {}, f"{scratch}/s", []
    for b in range(4):
        change = {}
        for key in own.sample([f"f{i}" for i in range(30)], 30 if b == 0 else 4):
            pkg = files.get(key, (f"p{own.randrange(4)}",))[0]
            gone = b > 0 and own.random() < 0.25
            change[key] = (f"p{own.randrange(4)}" if own.random() < 0.1 else pkg, None if gone else " ".join(
                own.choice(WORDS[own.randrange(4):]) for _ in range(own.randrange(0, 6))))
        batch = spark.createDataFrame([(k, p, t) for k, (p, t) in change.items()], SCHEMA)
        touched = D.apply_batch(spark, path, b, batch, done, _word_occurrences)
        for k, (p, t) in change.items():
            files.pop(k, None)
            if t is not None:
                files[k] = (p, t)
        done.append(b)
        assert touched["files"] == len(change)
        assert state(spark, path, done) == rebuild(files)
        if b == 2:  # the same batch again
            assert D.apply_batch(spark, path, b, batch, done, _word_occurrences) == touched
            assert state(spark, path, done) == rebuild(files)
            done = D.compact(spark, path, done, f"{scratch}/c")
            path = f"{scratch}/c"
            assert done == [2] and state(spark, path, done) == rebuild(files)


def test_only_dependents_are_diagnosed_again(spark, scratch):
    path = f"{scratch}/s"
    first = [(f"u{i}", "p" if i < 5 else "q", "name other") for i in range(40)] + [("d", "p", "Other"), ("e", "q", "Other")]
    D.apply_batch(spark, path, 0, spark.createDataFrame(first, SCHEMA), [], _word_occurrences)
    got = D.apply_batch(spark, path, 1, spark.createDataFrame([("d", "p", "Other Name")], SCHEMA), [0], _word_occurrences)
    assert got == {"files": 1, "diagnosed": 6, "index_rows": 1}  # the five files of p that use it, and the file
    got = D.apply_batch(spark, path, 2, spark.createDataFrame([("d", "p", "Other Name Name")], SCHEMA), [0, 1],
                        _word_occurrences)
    assert got == {"files": 1, "diagnosed": 1, "index_rows": 1}
    assert {r.key for r in D.diagnostics_state(spark, path, [0, 1, 2]).collect()} == {f"u{i}" for i in range(5, 40)}


def test_stream_equals_batches(spark, scratch):
    for i, text in enumerate(["One two", "Two one", "two"]):
        spark.createDataFrame([("a", "p", text, i), (f"b{i}", "p", "one", i)], SCHEMA + ", seq long").coalesce(1) \
            .write.parquet(f"{scratch}/in/{i}")
    stream = spark.readStream.schema(SCHEMA + ", seq long").option("recursiveFileLookup", "true") \
        .option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = D.derived_stream(stream, f"{scratch}/s", _word_occurrences).option(
        "checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    n = len([p for p in q.recentProgress if p["numInputRows"]])
    index, diags = state(spark, f"{scratch}/s", list(range(n)))
    assert n == 3 and index["p", "one"][1] >= 3 and sum(v[0] for v in index.values()) <= 1 and diags
