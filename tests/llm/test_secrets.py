import hashlib
import random
import re

from llm_fixtures import frame  # noqa: F401
from tessera.llm import secrets as S

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def contract(text):
    """The base kinds with Python's own regular expressions, in code points."""
    f = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 12]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    f += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(S.BASE[k], s, e) for s, k, e in sorted(f)]


def every_rule(text):
    found = []
    data = text.encode()
    for i, r in enumerate(S.RULES):
        for m in re.finditer(S.pattern(r.head) + b"(" + S.pattern(r.value) + b")", data):
            if len(m[0]) >= r.min_match and len(m[1]) >= r.min_value:
                found.append((len(data[:m.start()].decode()), i, len(data[:m.end()].decode())))
    return [(S.RULES[i].kind, s, e) for s, i, e in sorted(found)]


FRAGMENTS = ["token", "Secret", "API_KEY", "apikey", "passwd", "PassWord", "=", ":", " ", "'", '"', "AKIA",
             "abcdef0123456789", "ABCDEFGH12345678", "é", "ſecret", "K", "x", "ghp_", "eyJ", ".", "sk_live_",
             "-----BEGIN ", "PRIVATE KEY-----", "RSA ", "a" * 14, "\n", "xoxb-", "AIza", "Z9" * 20, "😀"]


def test_one_pass_matches_regular_expressions():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25)))
        got = S.scan(t.encode())
        assert [x for x in got if x[0] in S.BASE] == contract(t), t
        assert got == every_rule(t), t


def test_short_values_take_their_bytes():
    assert S.scan(b"token=secret: abcdefghijklmnop") == []
    assert S.scan(b"token = 'abcdefghijkl'") == [("assign", 0, 21)]


def test_automaton_is_minimal():
    dfa = S.scanner(S.RULES).all
    rows = dfa.step.reshape(-1, 256) // 256
    part = dfa.rules.copy()
    for _ in range(len(rows)):
        key = {}
        part = [key.setdefault((p, *(part[n] for n in row)), len(key)) for p, row in zip(part, rows.tolist())]
        if len(key) == len(rows):
            break
    assert len(set(part)) == len(rows)


def test_documents(frame):
    long = "x " * 200000 + "password=abcdefghijklmnop" + " é" * 10
    df = frame([(1, None, 9), (2, "", 9), (3, "é AKIA1234567890ABCD deadbeefdeadbeef0", 9), (3, "zz", 9),
                (None, long, 9)], "doc_id long, text string, spans int")
    got = {(r.doc_id, r.spans): r for r in S.scan_documents(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {k for k in got} == {(1, ""), (2, ""), (3, "access:2:20,hex:21:38"), (3, ""),
                                (None, "assign:400000:400025")}
    assert got[(1, "")].base_sha256 == empty
    r = got[(3, "access:2:20,hex:21:38")]
    assert (r.n_assign, r.n_access, r.n_hex) == (0, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert S.scan_documents(df.filter("false")).count() == 0
