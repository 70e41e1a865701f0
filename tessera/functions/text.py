"""Scalar functions over Columns.

Everything here builds a JVM-side expression (regex, higher-order array
functions, string and binary built-ins); nothing calls back into Python, so all
of it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# --------------------------------------------------------------------------
# Command lines
# --------------------------------------------------------------------------

# A word is a run of: a double-quoted part (closing quote optional), a
# backslash escape, a trailing backslash, or any non-space non-quote byte.
WORD_RX = r'(?s)(?:"(?:\\.|[^"\\])*"?|\\.|[^ \t\r\n"\\]|\\$)+'
# Inside a word: an escape pair or any character except the (vanishing) quote.
UNIT_RX = r'(?s)\\.|[^"]'
INT_RX = r'^[+-]?[0-9]+$'


def _unescape(unit: Column) -> Column:
    second = F.substring(unit, 2, 1)
    return (F.when((F.length(unit) == 2) & unit.startswith("\\"),
                   F.when(second == "n", F.lit("\n"))
                   .when(second == "t", F.lit("\t"))
                   .when(second == "r", F.lit("\r"))
                   .when(second == "b", F.lit("\b"))
                   .otherwise(second))
            .otherwise(unit))


def split_words(line: Column) -> Column:
    """shell-like words; quotes toggle and vanish, backslash escapes."""
    words = F.regexp_extract_all(line, F.lit(WORD_RX), 0)
    return F.transform(
        words,
        lambda w: F.array_join(
            F.transform(F.regexp_extract_all(w, F.lit(UNIT_RX), 0), _unescape), ""))


def atoi(s: Column) -> Column:
    """Integer value of a decimal string, 0 when it is not one."""
    return F.when(s.rlike(INT_RX), F.coalesce(s.try_cast("bigint"), F.lit(0))) \
        .otherwise(F.lit(0)).cast("bigint")


def parse_command(line: Column) -> Column:
    """struct(no, name, args); ``-n N`` is taken only with more than 2 args."""
    words = split_words(line)
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    take_n = (F.size(rest) > 2) & (F.try_element_at(rest, F.lit(1)) == "-n")
    no = F.when(take_n, atoi(F.try_element_at(rest, F.lit(2)))).otherwise(F.lit(0).cast("bigint"))
    args = F.when(take_n, F.slice(rest, 3, F.size(rest) - 2)).otherwise(rest)
    return F.struct(no.alias("no"), F.element_at(words, 1).alias("name"),
                    args.alias("args"))


def render_command(no: Column, name: Column, args: Column) -> Column:
    """inverse of F2 without quoting."""
    joined = F.array_join(args, " ")
    return F.when(no != 0, F.concat(name, F.lit(" -n "), no.cast("string"),
                                    F.lit(" "), joined)
                  ).otherwise(F.concat(name, F.lit(" "), joined))


# --------------------------------------------------------------------------
# $NAME / ${NAME} expansion from an explicit map column
# --------------------------------------------------------------------------

EXPAND_PART_RX = (r'\$\{[^}]*\}|\$\{|\$[*#$@!?0-9-]|\$[A-Za-z_][A-Za-z0-9_]*'
                  r'|\$|[^$]+')


def expand_vars(s: Column, mapping: Column) -> Column:
    """replace variables by their value in ``mapping`` (missing -> '')."""
    def one(p: Column) -> Column:
        braced = F.regexp_extract(p, r'^\$\{([^}]*)\}$', 1)
        plain = F.substring(p, F.lit(2), F.length(p))
        return (F.when(p == "$", p)
                .when(p == "${", F.lit(""))
                .when(p.startswith("${"),
                      F.when(braced == "", F.lit(""))
                      .otherwise(F.coalesce(F.try_element_at(mapping, braced), F.lit(""))))
                .when(p.startswith("$"),
                      F.coalesce(F.try_element_at(mapping, plain), F.lit("")))
                .otherwise(p))
    # A '$' as the very last character stays as it is.
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(EXPAND_PART_RX), 0), one), "")


# --------------------------------------------------------------------------
# double-quoted ASCII rendering with escapes
# --------------------------------------------------------------------------

def _hex(cp: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(cp)), width, "0")


def quote_ascii(s: Column) -> Column:
    """quoted string, non-ASCII as \\uXXXX or \\UXXXXXXXX."""
    def esc(c: Column) -> Column:
        cp = F.ascii(c)
        return (F.when(c == '"', F.lit('\\"'))
                .when(c == "\\", F.lit("\\\\"))
                .when(cp == 7, F.lit("\\a")).when(cp == 8, F.lit("\\b"))
                .when(cp == 12, F.lit("\\f")).when(cp == 10, F.lit("\\n"))
                .when(cp == 13, F.lit("\\r")).when(cp == 9, F.lit("\\t"))
                .when(cp == 11, F.lit("\\v"))
                .when((cp < 32) | (cp == 127), F.concat(F.lit("\\x"), _hex(cp, 2)))
                .when(cp < 128, c)
                .when(cp < 65536, F.concat(F.lit("\\u"), _hex(cp, 4)))
                .otherwise(F.concat(F.lit("\\U"), _hex(cp, 8))))
    # Runs of printable ASCII other than '"' and '\\' pass through whole; only
    # the remaining characters are escaped one by one.
    parts = F.regexp_extract_all(s, F.lit(QUOTE_RUN_RX), 0)
    body = F.array_join(F.transform(
        parts, lambda p: F.when(F.length(p) > 1, p).when(p.rlike(QUOTE_PLAIN_RX), p)
        .otherwise(esc(p))), "")
    return F.concat(F.lit('"'), F.coalesce(body, F.lit("")), F.lit('"'))


QUOTE_RUN_RX = r'[ !#-\[\]-~]+|(?s).'
QUOTE_PLAIN_RX = r'^[ !#-\[\]-~]$'


# --------------------------------------------------------------------------
# width of a parser error span
# --------------------------------------------------------------------------

def error_width(msg: Column) -> Column:
    """1, or the length of the identifier named after the fixed prefix."""
    prefix = rules.ERROR_WIDTH_PREFIX
    rx = "^" + prefix.replace(".", r"\.").replace("'", "'") + "[_A-Za-z]+"
    return F.when(msg.rlike(rx), F.octet_length(msg) - len(prefix.encode())).otherwise(1)


# --------------------------------------------------------------------------
# string literal -> value (null when it is not a valid literal)
# --------------------------------------------------------------------------

#: A valid escape: a letter, two hex digits, three octal ones, or a code point.
ESCAPE_RX = (r'\\(?:["\\abfnrtv]|x[0-9A-Fa-f]{2}|[0-3][0-7]{2}|u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}'
             r'|U(?:0000(?![dD][89a-fA-F])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4})')
QUOTED_RX = r'^"(?:[^"\\\n]|' + ESCAPE_RX + r')*"$'
RAW_RX = r'^`[^`]*`$'


def _code_point(cp: Column) -> Column:
    """UTF-8 bytes of a code point as hex digits."""
    def byte(lead: int, shift: int) -> Column:
        bits = F.shiftright(cp, shift)
        return F.hex(F.lit(lead) + (bits if lead >= 0xC0 else bits.bitwiseAND(F.lit(63))))
    return (F.when(cp < 0x80, F.lpad(F.hex(cp), 2, "0"))
            .when(cp < 0x800, F.concat(byte(0xC0, 6), byte(0x80, 0)))
            .when(cp < 0x10000, F.concat(byte(0xE0, 12), byte(0x80, 6), byte(0x80, 0)))
            .otherwise(F.concat(byte(0xF0, 18), byte(0x80, 12), byte(0x80, 6), byte(0x80, 0))))


def unquote(lit: Column) -> Column:
    """F7.  \\x and octal escapes are bytes, \\u and \\U code points; bytes that are no
    UTF-8 come out as replacement characters."""
    body = F.substring(lit, F.lit(2), F.length(lit) - 2)

    def one(u: Column) -> Column:
        kind, digits = F.substring(u, 2, 1), F.substring(u, F.lit(3), F.length(u))
        letters = {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B"}
        out = F.when(~u.startswith("\\"), F.hex(F.encode(u, "UTF-8")))
        for c, h in letters.items():
            out = out.when(kind == c, F.lit(h))
        return (out.when(kind == "x", F.upper(digits))
                .when(kind.isin("u", "U"), _code_point(F.conv(digits, 16, 10).cast("bigint")))
                .when(kind.rlike("[0-7]"), F.lpad(F.conv(F.substring(u, F.lit(2), F.length(u)), 8, 16), 2, "0"))
                .otherwise(F.hex(F.encode(kind, "UTF-8"))))
    parts = F.regexp_extract_all(body, F.lit(r"(?s)" + ESCAPE_RX + r"|[^\\]+"), 0)
    text = as_text(F.unhex(F.array_join(F.transform(parts, one), "")))
    return F.when(lit.rlike(RAW_RX), body).when(lit.rlike(QUOTED_RX), text)


# --------------------------------------------------------------------------
# Slash paths and dotted paths
# --------------------------------------------------------------------------

def path_base(p: Column) -> Column:
    """F8: last element; '.' for '', '/' for only slashes."""
    t = F.regexp_replace(p, "/+$", "")
    return (F.when(p == "", F.lit("."))
            .when(t == "", F.lit("/"))
            .otherwise(F.regexp_extract(t, "([^/]*)$", 1)))


def path_clean(p: Column) -> Column:
    """F8: lexical cleaning (collapse '//', drop '.', resolve '..')."""
    rooted = p.startswith("/")
    segs = F.split(p, "/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        n = F.size(acc)
        return (F.when((seg == "") | (seg == "."), acc)
                .when(seg == "..",
                      F.when((n > 0) & (F.element_at(acc, -1) != ".."),
                             F.slice(acc, 1, n - 1))
                      .when(rooted, acc)
                      .otherwise(F.array_append(acc, seg)))
                .otherwise(F.array_append(acc, seg)))

    kept = F.aggregate(segs, empty, step)
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def path_dir(p: Column) -> Column:
    """F8: directory part of a split path, cleaned."""
    return path_clean(F.regexp_extract(p, "^(.*/)?[^/]*$", 1))


def path_file(p: Column) -> Column:
    """Name part of a split path (after the last slash)."""
    return F.regexp_extract(p, "([^/]*)$", 1)


def path_join(a: Column, b: Column) -> Column:
    return path_clean(F.concat_ws("/", a, b))


def path_repr(parts: Column) -> Column:
    """dotted representation of a path given as its element list."""
    return F.array_join(parts, ".")


def path_from_str(s: Column, sep: str = ".") -> Column:
    return F.split(s, "\\" + sep if sep in ".|*+?" else sep)


# --------------------------------------------------------------------------
# F10 / F13 / F14 / F15 / F16 / F17 / F18
# --------------------------------------------------------------------------

#: Digits may be split by single underscores; a base prefix may precede one.
_DIGITS = r"[0-9](?:_?[0-9])*"
INT_RX = rf"0[xX](?:_?[0-9A-Fa-f])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|{_DIGITS}"
FLOAT_RX = (rf"{_DIGITS}\.(?:{_DIGITS})?(?:[eE][+-]?{_DIGITS})?|\.{_DIGITS}(?:[eE][+-]?{_DIGITS})?"
            rf"|{_DIGITS}[eE][+-]?{_DIGITS}"
            rf"|0[xX](?:(?:_?[0-9A-Fa-f])+\.?(?:[0-9A-Fa-f](?:_?[0-9A-Fa-f])*)?|\.[0-9A-Fa-f](?:_?[0-9A-Fa-f])*)"
            rf"[pP][+-]?{_DIGITS}")


def literal_class(tok: Column) -> Column:
    """Class of a literal token: STRING, CHAR, INT, FLOAT, IMAG, or null."""
    return (F.when(tok.rlike(r'(?s)^(".*"|`[^`]*`)$'), F.lit("STRING"))
            .when(tok.rlike(r"^'.*'$"), F.lit("CHAR"))
            .when(tok.rlike(rf"^(?:{FLOAT_RX}|{INT_RX})i$"), F.lit("IMAG"))
            .when(tok.rlike(rf"^(?:{FLOAT_RX})$"), F.lit("FLOAT"))
            .when(tok.rlike(rf"^(?:{INT_RX})$"), F.lit("INT")))


def literal_type(tok: Column) -> Column:
    """literal -> type name of the literal."""
    cls = literal_class(tok)
    out = F.lit(None).cast("string")
    for k, v in rules.LITERAL_TYPES.items():
        out = F.when(cls == k, F.lit(v)).otherwise(out)
    return out


def kind_label(kind: Column) -> Column:
    """declaration kind -> completion label."""
    return F.when(kind.isin(rules.KIND_LABELS), kind).otherwise(F.lit(rules.UNKNOWN_KIND_LABEL))


def loc_repr(fname: Column, pos: Column) -> Column:
    """``file:pos``."""
    return F.format_string("%s:%d", fname, pos)


_BUILTIN_TYPES = [n for k, n, _ in rules.BUILTINS if k == "TYPE"]


def type_repr(desc: Column) -> Column:
    """text of a type descriptor ('*T', '[]T', named, builtin)."""
    prefix = F.regexp_extract(desc, r'^((?:\*|\[\])*)', 1)
    base = F.substring(desc, F.length(prefix) + 1, F.length(desc))
    named = (F.when(base.isin(_BUILTIN_TYPES) | (base == "struct"), base)
             .otherwise(F.concat(F.lit("type "), base)))
    return F.concat(prefix, named)


def type_head(desc: Column) -> Column:
    """Constructor of the outermost type: Ref, Array, Struct, Builtin or IdType."""
    return (F.when(desc.startswith("*"), F.lit("Ref"))
            .when(desc.startswith("[]"), F.lit("Array"))
            .when(desc == "struct", F.lit("Struct"))
            .when(desc.isin(_BUILTIN_TYPES), F.lit("Builtin"))
            .otherwise(F.lit("IdType")))


def type_strip_pointer(desc: Column) -> Column:
    """F16: remove one leading pointer."""
    return F.when(desc.startswith("*"), F.substring(desc, F.lit(2), F.length(desc))).otherwise(desc)


def is_any(desc: Column) -> Column:
    """F16: the descriptor carries no information (any / error)."""
    return desc.isNull() | desc.isin("any", "error")


def setting_default(value: Column, default: Column) -> Column:
    """F17."""
    return F.coalesce(value, default)


def text_size(text: Column) -> Column:
    """size in bytes."""
    return F.octet_length(text)


# --------------------------------------------------------------------------
# P1 / P3 / P5 / F11 / F12
# --------------------------------------------------------------------------

def is_exported(name: Column) -> Column:
    """First byte is A..Z (ASCII only)."""
    return name.rlike("^[A-Z]")


def file_mode(path: Column) -> Column:
    """Source suffix -> SET-FILE-MODE, else DROP-FILE-MODE."""
    return F.when(path.endswith(rules.SOURCE_SUFFIX), F.lit(rules.SET_FILE_MODE)) \
        .otherwise(F.lit(rules.DROP_FILE_MODE))


def span_valid(beg: Column, end: Column, size: Column) -> Column:
    """P5: both ends inside the file."""
    return beg.between(0, size) & end.between(0, size)


def clamp_offset(p: Column, size: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0)), size)


def clamp_span(beg: Column, end: Column, size: Column) -> Column:
    """struct(beg, end) clamped; an empty span is widened one byte left."""
    cb = clamp_offset(beg, size)
    ce = clamp_offset(end, size)
    cb = F.when((cb == ce) & (cb != 0), cb - 1).otherwise(cb)
    return F.struct(cb.alias("beg"), ce.alias("end"))


def splice(old_bin: Column, beg: Column, end: Column, new_bin: Column) -> Column:
    """``old[:beg] + new + old[end:]`` on bytes (BINARY in, BINARY out)."""
    return F.concat(F.substring(old_bin, F.lit(1), beg), new_bin,
                    F.substring(old_bin, end + 1, F.octet_length(old_bin)))


def as_text(bin_col: Column) -> Column:
    """BINARY -> STRING without failing on a cut code point."""
    return F.make_valid_utf8(bin_col.cast("string"))
