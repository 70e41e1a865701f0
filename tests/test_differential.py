"""Every registered query against its DuckDB oracle on small crafted tables
full of edge cases (quotes, backslashes, control characters, CR/FF, emoji,
keywords, unterminated strings, empty texts, URLs without paths, '..',
non-ASCII hosts, comments hiding tags, missing props keys, multi-byte turns)."""

import collections
import datetime as dt
import os
import sys

import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

TEXTS = ['He said "hi" and \\left; for x := range y { return 3.14 }',
         "tab\tcr\r\nff\fvt\x0bnul-ish \x01 end",
         "emoji 😀 and ünïcödé Ωmega ÉCOLE école 42abc abc42 _under __x",
         '"unterminated string\nnext line" "ok" ""',
         "",
         "Func func FUNC type Type var VAR package import",
         "a" * 50 + " " + "Zz" * 30,
         "line1\nline2\n\n\n   \n"]


def _write(d):
    docs = pd.DataFrame({"doc_id": list(range(len(TEXTS))), "text": TEXTS,
                         "lang": ["en", "fr", "de", "en", "es", "en", "fr", "de"],
                         "source": ["s1", "s1", "s2", 's"q', "s2", "s1", "s3", "s1"]})
    docs["n_chars"] = docs.text.str.len()
    docs.to_parquet(f"{d}/documents.parquet")
    pd.DataFrame({"page_id": [0, 1, 2, 3, 4, 5],
                  "url": ["http://h.example", "https://h.example/", "https://h.example/a/../b/c.html?x=1#f",
                          "http://ü.example/dir//sub/7x", "ftp://x.example/7/", "https://h.example/a/b/"],
                  "html": ["", "<div>Ab ab</div>", "<!-- <div> --> <nav><a>Link link</a></nav>",
                           "<ul><li>One one</li><li>Two two</li></ul>", "< notatag <b>Bold bold</b>",
                           "<article><h1>T t</h1></article> </div> <div>"]}).to_parquet(f"{d}/pages.parquet")
    pd.DataFrame({"event_id": list(range(8)),
                  "ts": pd.to_datetime([dt.datetime(2024, 1, 1)] * 8).astype("datetime64[us]"),
                  "user_id": [1, 1, 2, 1, 2, 3, 1, 2],
                  "event_type": ["signup", "purchase", "error", "signup", "purchase", "view", "error", "signup"],
                  "value": [1.0] * 8,
                  "props": ['{"k": 1}', '{"k": 2}', '{}', '{"k": "x y"}', '{"k": 5}', '{"j": 1}', '{"k": 7}',
                            '{"k": 8}']}).to_parquet(f"{d}/events.parquet")
    pd.DataFrame({"conv_id": [0, 0, 0, 1, 1, 2], "turn": [0, 1, 2, 0, 1, 0],
                  "role": ["user", "assistant", "system", "user", "user", "assistant"],
                  "text": ["héllo", "wörld 😀", "sys", "ab", "cd", "x"]}).to_parquet(f"{d}/conversations.parquet")
    pd.DataFrame({"p_partkey": [0, 1, 2, 3], "p_name": ["a", "b", "c", "d"],
                  "p_brand": ["B#1", "B#1", "B#2", "B#2"], "p_type": ["T1", "T2", "T1", "T3"],
                  "p_size": [0, 1, 2, 3], "p_retailprice": [900.0, 960.0, 10.0, 949.9]}).to_parquet(f"{d}/part.parquet")


def test_all_queries_match_oracles_on_edge_cases(spark, scratch):
    import duckdb

    from check import norm
    from tessera.plans import ORACLES, QUERIES, load_all
    load_all()
    _write(scratch)
    con = duckdb.connect()
    for t in ["documents", "pages", "events", "conversations", "part"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{scratch}/{t}.parquet')")
    bad = []
    for name, fn in sorted(QUERIES.items()):
        sdf = fn(spark, scratch)
        cols = sdf.columns
        got = collections.Counter(tuple(norm(x) for x in r) for r in sdf.collect())
        r = con.sql(ORACLES[name])
        oc = r.columns
        want = collections.Counter(tuple(norm(row[oc.index(c)]) for c in cols) for row in r.fetchall())
        if got != want:
            bad.append((name, sorted((got - want).elements(), key=str)[:2],
                        sorted((want - got).elements(), key=str)[:2]))
    assert not bad, bad
