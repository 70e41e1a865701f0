"""Property tests: one DataFrame of generated inputs per property."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T

ESCAPES = {7: "\\a", 8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t", 11: "\\v",
           34: '\\"', 92: "\\\\"}


def expected_quote(s: str) -> str:
    """ASCII-only double-quoted form: the escape table above, other control
    bytes as \\xHH, non-ASCII as \\uXXXX or \\UXXXXXXXX (lower-case hex)."""
    parts = []
    for ch in s:
        c = ord(ch)
        if c in ESCAPES:
            parts.append(ESCAPES[c])
        elif c < 0x20 or c == 0x7F:
            parts.append(f"\\x{c:02x}")
        elif c < 0x80:
            parts.append(ch)
        elif c < 0x10000:
            parts.append(f"\\u{c:04x}")
        else:
            parts.append(f"\\U{c:08x}")
    return '"' + "".join(parts) + '"'


chars = st.one_of(st.characters(min_codepoint=0, max_codepoint=0x7F),
                  st.characters(min_codepoint=0x80, max_codepoint=0xFFFF, blacklist_categories=("Cs",)),
                  st.characters(min_codepoint=0x10000, max_codepoint=0x10FFFF))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=chars, max_size=40), min_size=1, max_size=60))
def test_quote_ascii_property(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i long, s string")
    got = {r.i: r.q for r in df.select("i", T.quote_ascii(F.col("s")).alias("q")).collect()}
    assert got == {i: expected_quote(s) for i, s in enumerate(batch)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=chars, max_size=30), min_size=1, max_size=40),
       st.integers(0, 40), st.integers(0, 40), st.text(alphabet=chars, max_size=5))
def test_splice_property(spark, batch, b, e, new):
    rows = [(i, s) for i, s in enumerate(batch)]
    df = spark.createDataFrame(rows, "i long, s string")
    out = df.select("i", T.splice(F.encode("s", "UTF-8"), F.lit(b), F.lit(e),
                                  F.encode(F.lit(new), "UTF-8")).alias("b")).collect()
    got = {r.i: bytes(r.b) for r in out}
    for i, s in rows:
        raw = s.encode()
        # old[:beg] + new + old[end:] on bytes; offsets past the end clamp
        assert got[i] == raw[:b] + new.encode() + raw[e:], (s, b, e)
