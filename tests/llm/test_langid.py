import math
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import SF01, frame  # noqa: F401

from tessera.llm import langid as L

DOCS = [(1, "the cat and the dog of the house with the things that they were", "en", 0),
        (2, "der hund und die katze in dem haus mit der sache nicht auch", "de", 0),
        (3, "le chat et le chien dans la maison avec les choses que nous", "fr", 0),
        (4, "no language here", None, 0), (5, None, "en", 0)]


def page(text, lang=None):
    return f"<!DOCTYPE html><html{f' lang={lang!r}' if lang else ''}><body><p>{text}</p></body></html>"


PAGES = [(i, f"http://h{i % 3}.site.de/{i}", page("der hund und die sache", "de"), "x") for i in range(6)] + [
    (10, "http://h1.site.de/x", page(""), "x"), (11, "http://www.other.com/", page("the dog and the house", "de"), "x"),
    (12, "http://www.other.com/", page("the things that they were", "en"), "x"), (13, None, None, "x"),
    (14, "nonsense", "", "x"), (14, "http://www.other.com/", page("&amp; <b>le chat et les choses</b>", "FR"), "x"),
    (None, "http://u@h1.site.de:80/x", "<script>the the the</script>", "x")]


def brute(pages, docs):
    """The same formulas page by page."""
    langs = sorted({d[2] for d in docs if d[2]})
    counts = np.full((len(langs), L.BUCKETS), 0.5)
    for _, t, lang, _x in docs:
        if lang:
            for g in L.trigrams((t or "").encode()):
                counts[langs.index(lang), g] += 1
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    ll = [np.array(L.log_likelihood((h or "").encode(), model)) for _, _, h, _x in pages]
    post = [np.exp(v) / np.exp(v).sum() for v in ll]
    import re
    host = [(re.match(r"[a-z]+://(?:[^/@]*@)?([^/?#:]*)", u or "") or [0, ""])[1] for _, u, _h, _x in pages]
    said = [(re.search(r"<html\b[^>]*\blang='?(\w+)", h or "") or [0, ""])[1].lower() for _, _u, h, _x in pages]
    out = []
    for i in range(len(pages)):
        def level(match):
            own = sum((post[j] for j in range(len(pages)) if j != i and match(j)), np.zeros(len(langs)))
            return own
        prior = np.full(len(langs), 1 / len(langs))
        cut = [lambda h: "", lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]
        for c in cut:
            own = level(lambda j: c(host[j]) == c(host[i]))
            prior = (own + L.STRENGTH * prior) / (own.sum() + L.STRENGTH)
        d, t = level(lambda j: said[j] == said[i]), level(lambda j: True)
        like = (d + 1 / len(set(said))) / (t + 1)
        fused = np.exp(ll[i]) * prior * like
        out.append((host[i], said[i], langs[int(np.argmax(post[i]))], langs[int(np.argmax(fused))],
                    float(fused.max() / fused.sum())))
    return out


def test_matches_page_by_page(frame, spark):
    pages = frame(PAGES, "page_id long, url string, html string, host string")
    docs = frame(DOCS, "doc_id long, text string, lang string, n_chars long")
    got = L.identify(spark, pages, docs).collect()
    want = brute(PAGES, DOCS)
    key = lambda x: (str(x[0]), *x[1:5])
    a = sorted([(r.page_id, r.host, r.declared, r.text_lang, r.lang, r.prob) for r in got], key=key)
    b = sorted([(p[0], *w) for p, w in zip(PAGES, want)], key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    for x, y in zip(a, b):
        assert x[5] == pytest.approx(y[5], abs=1e-6)
    # A page without text takes its host's language.
    assert {r.page_id: r.lang for r in got}[10] == "de"


def test_visible_text():
    assert L.visible(b"<style>a</style>x<!-- y --><script>z").split() == [b"x"]
    assert len(L.trigrams(b"")) == 0 and len(L.trigrams(b"ab")) == 2


def test_visible_text_and_trigrams_match_a_plain_form():
    import random
    import re
    plain = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>|&#?\w+;")
    own = random.Random(1)
    bits = [b"<", b">", b"<script", b"</script >", b"<style>", b"</style", b"<!--", b"-->", b"--", b"&amp;", b"&#9",
            b";", b"a", b" b", b"\n", "\u00e9".encode(), b"/", b"<p>", b"&"]
    for _ in range(6000):
        h = b"".join(own.choice(bits) for _ in range(own.randint(0, 14)))
        assert L.visible(h) == plain.sub(b" ", h), h
        t = b" " + b" ".join(h.lower().split()) + b" "
        want = [((a * 65599 * 65599 + b * 65599 + c) * 2654435761 % 2**32) >> 19 for a, b, c in zip(t, t[1:], t[2:])]
        assert L.trigrams(h).tolist() == want


@pytest.mark.parametrize("bad", [b"<", b"a< b ", b"<!", b"&a", b"<script ", b"</script ", b"<html ", b"--"])
def test_broken_markup_takes_linear_time(bad):
    import time
    start = time.time()
    L.visible(bad * (10_000_000 // len(bad)))
    assert time.time() - start < 20


def test_broken_markup_in_the_declaration(frame, spark):
    rows = [(1, None, "<html " * 500_000), (2, None, "<html class=x lang='de'>"), (3, None, "<html <html lang=fr>")]
    pages = frame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    docs = frame(DOCS, "doc_id long, text string, lang string, n_chars long")
    assert {r.page_id: r.declared for r in L.identify(spark, pages, docs).collect()} == {1: "", 2: "de", 3: "fr"}


def test_no_labels_and_empty(frame, spark):
    pages = frame(PAGES, "page_id long, url string, html string, host string")
    docs = frame(DOCS, "doc_id long, text string, lang string, n_chars long")
    rows = L.identify(spark, pages, docs.filter("lang is null")).collect()
    assert len(rows) == len(PAGES) and all(r.lang is None and r.prob is None for r in rows)
    assert L.identify(spark, pages.filter("false"), docs).count() == 0


def test_fixture_accuracy(spark):
    """The text alone finds the declared language of nearly all pages of the fixture."""
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    rows = L.identify(spark, pages, spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    assert len(rows) == pages.count() and all(0 < r.prob <= 1 + 1e-9 for r in rows)
    named = [r for r in rows if r.declared]
    assert sum(r.lang == r.declared for r in named) >= 0.9 * len(named)
    assert math.isfinite(sum(r.prob for r in rows)) and defaultdict(int)[0] == 0
