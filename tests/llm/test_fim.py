import hashlib
import random
import re

import pytest
from llm_fixtures import frame  # noqa: F401

from tessera.llm import fim

PIECES = ["word", "A", "z", "\u00e9", "\U0001f600", " ", "\n", "9", "<P", "<P>", "<S>", "<M>", "<", ">", "Zz" * 9]


def plain_form(text, row_id, seed=1):
    """The contract, unit by unit."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hx = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    h = [int(hx[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 20:
        return n, "spm", len(a), len(b), "<S>" + c + "<P>" + a + "<M>" + b
    return n, "psm", len(a), len(b), "<P>" + a + "<S>" + c + "<M>" + b


def ends(text):
    return [0, *[m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]]


def test_every_container_form_selects_exactly(monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", " ", "a" * 70000, " " * 140000, "ab " * 50000, "abcdefghijklmnopqr " * 9000,
             "".join(rng.choice(["aa", "a", " ", "-"]) for _ in range(60000)), "a" * 65536, " " * 65536,
             "a" * 65535 + " b" + "c" * 65536]
    forms = set()
    for t in texts:
        s, want = fim.BoundarySet(t), ends(t)
        assert len(s) == len(want)
        ranks = sorted({0, len(want) - 1, *(rng.randrange(len(want)) for _ in range(200))})
        assert s.select(ranks) == [want[k] for k in ranks]
        assert [sum(map(len, s.containers[:i + 1])) for i in range(len(s.containers))] == s.cumulative.tolist()
        forms |= {c.kind for c in s.containers}
    assert forms == {"array", "bitmap", "run"}
    monkeypatch.setattr(fim, "CHUNK", 16)
    monkeypatch.setattr(fim, "BITMAP_BYTES", 2)
    for _ in range(300):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert fim.BoundarySet(t).select(range(len(ends(t)))) == ends(t)


def test_smallest_form_is_taken():
    import numpy as np
    assert fim.Container.of(0, np.arange(5000)).kind == "run"
    assert fim.Container.of(0, np.array([1, 5, 900])).kind == "array"
    assert fim.Container.of(0, np.arange(0, 60000, 3)).kind == "bitmap"


def test_matches_the_plain_form_and_restores(frame, spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PIECES[:-6] if i % 3 else PIECES) for _ in range(rng.randint(0, 200))), "x", 1)
            for i in range(300)]
    rows += [(7, "again and again", "x", 1), (7, "again and again", "x", 1), (400, None, None, None),
             (401, "", "x", 1), (None, "no id here", "x", 1), (402, "long " * 60000, "x", 1)]
    df = frame(rows, "doc_id long, text string, output string, n long")
    key = lambda r: str(r)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
           for r in fim.fill_in_middle(df).collect()]
    want = [(i, *plain_form(t or "", "" if i is None else i)) for i, t, _, _ in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    report = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fim_report(df).collect()]
    assert sorted(report, key=key) == sorted(
        [(i, sha(w[5]), sha(t or "")) for (i, t, _, _), w in zip(rows, want)], key=key)


def test_empty_table_and_text_ids(frame, spark):
    df = frame([("k1", "some words, here"), (None, None)], "doc_id string, text string")
    assert fim.fim_report(df.filter("false")).count() == 0
    got = {r.doc_id: r.output for r in fim.fill_in_middle(df, seed=5).collect()}
    assert got["k1"] == plain_form("some words, here", "k1", 5)[4] and got[None] == ""


@pytest.mark.parametrize("percent", [0, 100])
def test_shares_are_parameters(frame, percent):
    df = frame([(i, "a few words") for i in range(60)], "doc_id long, text string")
    forms = {r.form for r in fim.fill_in_middle(df, plain=0, spm=percent).collect()}
    assert forms == {"spm" if percent else "psm"}
    assert {r.form for r in fim.fill_in_middle(df, plain=100).collect()} == {"plain"}
