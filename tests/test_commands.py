"""Command lines: F1 split, F2 parse, F3 render, F4 expand, F5 quote."""

from pyspark.sql import functions as F

from tessera.functions import text as T


def _one(spark, col_fn, value, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_fn(F.col("s")).alias("r")).first()["r"]


def test_split_words_edge_cases(spark):
    cases = {
        'a b  c': ["a", "b", "c"],
        'go-path "/home/x y/go"': ["go-path", "/home/x y/go"],
        'ab"c d"e f': ["abc de", "f"],          # quotes inside a word vanish
        'x "unclosed quote': ["x", "unclosed quote"],
        'tail\\': ["tail\\"],                   # trailing backslash kept
        'a\\ b': ["a b"],                       # escaped space joins
        'esc\\n\\t\\q': ["esc\n\tq"],
        'empty "" word': ["empty", "", "word"],
        '  \t lead': ["lead"],
        '"quo\\"ted"': ['quo"ted'],
    }
    for line, want in cases.items():
        assert _one(spark, T.split_words, line) == want, line


def test_parse_command_n_flag(spark):
    def parse(line):
        r = _one(spark, T.parse_command, line)
        return r["no"], r["name"], list(r["args"])
    assert parse("complete -n 5") == (0, "complete", ["-n", "5"])          # exactly 2: not taken
    assert parse("analyze -n 9 file.go") == (9, "analyze", ["file.go"])    # 3: taken
    assert parse("analyze -n x file.go") == (0, "analyze", ["file.go"])    # bad number -> 0
    assert parse("load-project") == (0, "load-project", [])


def test_render_round_trip(spark):
    for line in ["analyze -n 9 a.go", "complete f.go 118", "find-files 7 system 40"]:
        df = spark.createDataFrame([(line,)], "s string")
        c = T.parse_command(F.col("s"))
        out = df.select(T.render_command(c.no, c["name"], c.args).alias("r")).first()["r"]
        assert out == line


def test_expand_vars(spark):
    df = spark.createDataFrame([("$A/${B}/$NONE/${}/$/x$",)], "s string")
    m = F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2"))
    assert df.select(T.expand_vars(F.col("s"), m).alias("r")).first()["r"] == "1/2///$/x$"


def test_quote_ascii(spark):
    cases = {
        "plain": '"plain"',
        'q"b\\': '"q\\"b\\\\"',
        "tab\tnl\n": '"tab\\tnl\\n"',
        "é": '"\\u00e9"',
        "😀": '"\\U0001f600"',
        "\x01\x7f": '"\\x01\\x7f"',
        "": '""',
    }
    for s, want in cases.items():
        assert _one(spark, T.quote_ascii, s) == want, repr(s)


def test_unquote_and_paths(spark):
    assert _one(spark, T.unquote, '"a/b\\tc"') == "a/b\tc"
    assert _one(spark, T.unquote, '"bad') is None
    assert _one(spark, T.unquote, "`raw\\n`") == "raw\\n"
    assert _one(spark, T.path_clean, "a//b/./c/../d/") == "a/b/d"
    assert _one(spark, T.path_clean, "/../x") == "/x"
    assert _one(spark, T.path_clean, "") == "."
    assert _one(spark, T.path_base, "a/b/") == "b"
    assert _one(spark, T.path_base, "///") == "/"
    assert _one(spark, T.path_dir, "/src/pkg/f.go") == "/src/pkg"
    assert _one(spark, T.error_width, "expected '.', found 'IDENT' abc") == 3
    assert _one(spark, T.error_width, "other") == 1
