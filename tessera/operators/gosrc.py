"""Go source rules over the generic span jobs.

The Go grammar is not rebuilt.  Tokens come from the Go token pattern; every
rule looks at neighbouring significant tokens (``lag``/``lead`` over the
document) and at the enclosing brace and paren scopes (``annotate_scopes``,
run once over parentheses and once over braces).  Rules:

* declarations: ``package N``; ``import "p"`` / ``import a "p"`` and import
  groups (PACKAGE, name = alias or last path element); ``func N`` and
  ``func (r T) N`` (FUNC); ``type N`` (TYPE); ``var N``
  (VAR); ``const N`` (CONST); a name starting a line inside ``var (``,
  ``const (`` or ``type (``; every name of ``a, b :=`` (VAR, visible from its
  own begin, so ``x := x`` reads the new ``x``); parameter names of functions
  and function literals, also in ``a, b int`` lists (VAR, visible in the
  body).  ``_`` is never declared.
* references: the other identifiers, except selector members (after ``.``),
  struct fields and labels.
  A name declared in the header of ``for``, ``if``, ``switch`` or ``select``
  ends with the statement's last block; a parameter of a signature without a
  body ends with itself.
* type positions: after a declared name, in signature lists (parameters,
  receivers, results, variadics) and single results, elements and keys of
  arrays, maps and channels, struct fields and embedded types, the right side
  of ``type A B``, ``x.(T)``, ``make(T`` and ``new(T``, literals ``T{``, and
  the case labels of a type switch (W3).
* resolution: local sweep, file tier, package tier (sibling files, when the
  files carry a package), builtin tier; members through declared types and
  struct fields, across the files of a package.
* diagnostics: undefined type, type ident required, struct type required,
  pointer type required, ``make()`` without a type, ident node required,
  invalid path syntax, unbalanced braces, parentheses and brackets, and on
  request undefined values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..session import stored
from .resolve import resolve_refs
from .scopes import annotate_scopes
from .tokens import tokenize

KIND_DEF_CLASS = {"VAR": rules.CLS_VAR_DEF, "CONST": rules.CLS_CON_DEF,
                  "TYPE": rules.CLS_TYPE_DEF, "PACKAGE": rules.CLS_TYPE_DEF,
                  "FUNC": rules.CLS_METH_DEF}
KIND_REF_CLASS = {"VAR": rules.CLS_VAR, "CONST": rules.CLS_CON, "TYPE": rules.CLS_TYPE,
                  "PACKAGE": rules.CLS_TYPE, "FUNC": rules.CLS_METH}
TYPE_WORDS = ["map", "chan", "func", "struct", "interface"]


def _is_ident(c):
    return c.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & ~c.isin(rules.GO_KEYWORDS)


def go_base_class(tok):
    """X2 for Go tokens without name resolution."""
    return (F.when(tok.rlike(r"^[ \t\r\n\f]+$"), F.lit(None).cast("string"))
            .when(tok.startswith("//") | tok.startswith("/*"), F.lit(rules.CLS_COMMENT))
            .when(tok.startswith('"') | tok.startswith("`"), F.lit(rules.CLS_STRING))
            .when(tok.startswith("'"), F.lit(rules.CLS_CHAR))
            .when(tok.rlike(r"^\.?[0-9]"), F.lit(rules.CLS_NUMBER))
            .when(tok.isin(rules.GO_KEYWORDS), F.lit(rules.CLS_KEYWORD))
            .when(_is_ident(tok), F.lit(rules.CLS_VAR))
            .when(tok.isin(".", ","), F.lit(None).cast("string"))
            .when(tok.isin(":=", ";", ":", "<-"), F.lit(rules.CLS_SEPARATOR))
            .when(tok.isin("{", "}", "(", ")", "[", "]", "..."), F.lit(rules.CLS_TOKEN))
            .otherwise(F.lit(rules.CLS_OPERATOR)))


def go_tokens(files: DataFrame, key: str = "doc_id", text: str = "text",
              package: str | None = None, parts: int | None = None) -> DataFrame:
    """Tokens but white space, with brace scopes and neighbouring significant tokens.
    ``package``: column naming the package (directory) of each file; its
    top-level names then become visible in the sibling files (package tier).
    ``parts``: partitions of the files (see ``text_parts``)."""
    if package:
        files = files.withColumn("pkg", F.col(package))
    t = tokenize(files, key, text, rules.GO_TOKEN_RX, keep=["pkg"] if package else None, parts=parts)
    # Every window below sorts all tokens, so those of one order stand together and what
    # they need is made ready before.  First in text order, as the tokens come.
    wa = Window.partitionBy(key).orderBy("i")
    t = t.withColumn("raw_prev", F.lag("tok", 1).over(wa)).withColumn("raw_next", F.lead("tok", 1).over(wa))
    # White space has told its neighbours what it is; no later window carries it.
    t = t.filter(~F.col("tok").rlike(r"^[ \t\r\n\f]+$"))
    # Evaluated once, before the next window; neighbours get it by lag and lead.
    tok, star = F.col("tok"), F.col("tok").isin("*", "...")
    t = t.withColumn("sig", ~(tok.startswith("//") | tok.startswith("/*"))).withColumn("ident", _is_ident(tok))
    t = t.withColumn("_brk", F.when(tok == ":=", F.col("i")).when(~(F.col("ident") | (tok == ",")), F.lit(-1)))
    # Then the significant tokens in order (comments are in no scope): neighbours and all
    # running sums and last values that they alone decide.
    w = Window.partitionBy(key, "sig").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(tok.isin("for", "if", "switch", "select"), F.lit(True)).when(
        tok.isin("{", "}") & block_brace(), F.lit(False))
    near = {**{f"p{j}": F.lag("tok", j).over(w) for j in range(1, 6)},
            **{f"n{j}": F.lead("tok", j).over(w) for j in range(1, 6)},
            "p2i": F.lag("i", 2).over(w), "n1i": F.lead("i", 1).over(w), "n1_id": F.lead("ident", 1).over(w),
            "_p1_id": F.lag("ident", 1).over(w), "_p1_raw": F.lag("raw_prev", 1).over(w),
            "_parens": F.sum(F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).over(upto),
            "_braces": F.sum(F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)).over(upto),
            # the last token before that is no ``*`` or ``...``
            "_plain": F.last(F.when(~star, tok), ignorenulls=True).over(before),
            # Inside a header: a block keyword came after the last brace.
            "in_header": F.coalesce(F.last(head, ignorenulls=True).over(upto), F.lit(False)),
            # ``:=`` at the end of a name list (walked over ``name ,`` pairs): the next break
            "_next_stop": F.coalesce("_brk", F.expr(
                f"lead(_brk) IGNORE NULLS OVER (PARTITION BY `{key}`, sig ORDER BY i)"))}
    t = t.withColumns(near).drop("_brk")
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    # Paren groups: each token learns the keyword before its innermost open '(' (``var (``,
    # ``const (``, ``type (``, ``import (``), or that the group is a list of a function
    # signature: after ``func``, ``func name``, a method's ``) name`` on one line, a result
    # list ``) (`` (a call of a call has no space there).
    signature = ((p1 == "func") | (F.col("_p1_id") & (p2 == "func"))
                 | (F.col("_p1_id") & (p2 == ")") & ~F.col("_p1_raw").contains("\n"))
                 | ((p1 == ")") & (F.col("raw_prev") == " ")))
    # Only what the rules ask of the farther neighbours goes on: every sort and window below
    # copies whole rows, so their text would cost more than all rules together.
    t = t.withColumns({
        # what opens a brace: "T struct", ") {" of a body, ... (two tokens before)
        "_opener": F.when(tok == "{", F.concat_ws(" ", p2, p1)),
        "_signature": signature,
        "type_next": F.when(F.col("ident"), type_after()),
        # type A B; []*T, [N]*T, map[K]*V
        "type_led": F.coalesce(((p1 == "=") & (p3 == "type")) | (p1.isin("*", "...") & (p2 == "]") & (
            (p3 == "[") | ((F.col("p4") == "[") & (F.col("p5") == "map")))), F.lit(False)),
        "p2_import": F.coalesce(p2 == "import", F.lit(False)),
        "p3_dot": F.coalesce(p3 == ".", F.lit(False)),
        "bare_make": F.coalesce((tok == "make") & (F.col("n1") == "(") & (F.col("n2") == ")"), F.lit(False)),
    }).drop(*(f"{s}{j}" for s in "pn" for j in range(2, 6)), "_p1_id", "_p1_raw")
    # A ')' learns the tag of the '(' it closes: the tag event before it on its level.
    pa = annotate_scopes(t, key, F.col("sig") & (tok == "("), F.col("sig") & (tok == ")"),
                         F.when(F.col("_signature"), F.lit(SIGNATURE)).otherwise(F.coalesce(p1, F.lit(""))),
                         balance="_parens", closes={"closes": F.col("tag")})
    pa = pa.select(*t.columns, "closes", F.col("scope_tag").alias("group_kw"),
                   F.col("scope_i").alias("pgroup")).drop("_parens", "_signature")
    a = annotate_scopes(pa, key, tok == "{", tok == "}", F.lit("{"), extra="_opener", balance="_braces",
                        closes={"_ends_block": block_brace()}).drop("_opener", "_braces")
    # ``a, b int``: a name before ',' takes the type of the next typed name.
    typeish = (F.col("n1_id") | F.col("n1").isin("*", "[", "...")
               | F.col("n1").isin(TYPE_WORDS))
    pair = F.col("sig") & F.col("ident") & F.col("p1").isin("(", ",") & typeish
    wrt = (Window.partitionBy(key, "pgroup").orderBy(F.desc("i"))
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a = a.withColumn("run_type", F.last(F.when(pair, F.col("type_next")), ignorenulls=True).over(wrt))
    # A paren group holds named parameters when some name is directly followed
    # by a type; then every name before ',' in it is a parameter too.
    a = a.withColumn("named_group", F.when(F.col("pgroup").isNotNull(), F.max(pair.cast("int")).over(
        Window.partitionBy(key, "pgroup")) > 0).otherwise(F.lit(False)))
    # Reverse sweeps at one depth.  Body of a function: the block brace that comes before the
    # line ends outside its lists.  End of a header's scope: the first '}' of a block that no
    # ``else`` follows.
    wb = (Window.partitionBy(key, "depth").orderBy(F.desc("i"))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    none = F.lit(None).cast("bigint")
    body = F.when((F.col("kind") == "open") & block_brace(),
                  F.struct(F.lit(True).alias("has"), F.col("partner_beg").alias("end"))) \
        .when(F.col("sig") & F.col("raw_prev").contains("\n") & F.col("pgroup").isNull(),
              F.struct(F.lit(False).alias("has"), none.alias("end")))
    chain = F.when(F.col("_ends_block") & (F.col("n1").isNull() | (F.col("n1") != "else")), F.col("beg"))
    a = a.withColumns({"_body": F.last(body, ignorenulls=True).over(wb),
                       "_header_end": F.last(chain, ignorenulls=True).over(wb)}).drop("_ends_block")
    # The last token before that is no ``*`` or ``...``, and the one before it.
    back = F.when(~star, F.struct(tok.alias("t"), F.col("ident").alias("id"), F.col("_plain").alias("prev"),
                                  F.col("closes").alias("closes")))
    a = a.withColumn("q", F.last(back, ignorenulls=True).over(before))
    # What no rule reads is not written with the tokens.
    return a.drop("_plain", "tag", "level", "partner_i", "partner_tag", "partner_beg", "partner_end",
                  "scope_tag", "scope_beg", "closes")


#: Bytes of Go text of a partition: a sort of their tokens then stays in a task's memory.
PART_BYTES = 2 << 20


def text_parts(files: DataFrame, text: str = "text") -> int:
    """Partitions for the tokens of ``files``, by the bytes of their texts."""
    n = files.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_BYTES))


def stored_tokens(a: DataFrame, key: str = "doc_id") -> DataFrame:
    """``a`` written once for several readers, with what ``go_items`` finds instead of what only it
    reads, so no reader sorts the tokens again."""
    return stored(_item_columns(a, key).drop(
        "q", "_body", "_header_end", "in_header", "_next_stop", "run_type", "named_group", "type_led",
        "scope_end", "_typed", "_after_name"), "tokens")


def large(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sorted shuffles: it grows with the tokens, while the planner's
    estimate (of the files' few bytes, before tokens are made) would broadcast it."""
    return df.hint("merge")


#: Tag of the paren groups of a function signature.
SIGNATURE = "func ("


def block_brace():
    """A ``{`` that opens a block or a type: white space before it (a literal's has none)."""
    return F.col("raw_prev").rlike(r"^[ \t\r\n\f]+$") | (F.col("tok") == "}")


def go_items(a: DataFrame, key: str = "doc_id") -> DataFrame:
    """Declarations and references (one row per identifier token)."""
    a = a if "_is_decl" in a.columns else _item_columns(a, key)
    extra = ["pkg"] if "pkg" in a.columns else []
    return a.filter(F.col("_is_decl") | F.col("_is_ref")).select(
        key, *extra, "i", "tok", F.col("_name").alias("name"), "beg", "end", "depth",
        F.col("_is_decl").alias("is_decl"), F.col("_is_ref").alias("is_ref"), F.col("_local").alias("local"),
        F.col("_vis_end").alias("vis_end"), F.col("_kind").alias("kind"), F.col("_type_pos").alias("type_pos"),
        F.col("_dtype").alias("dtype"))


def _item_columns(a: DataFrame, key: str) -> DataFrame:
    """``a`` with what each token declares or refers to (``_is_decl``, ``_is_ref``, ``_kind`` and so on)."""
    tok, p1, n1 = F.col("tok"), F.col("p1"), F.col("n1")
    ident = F.col("sig") & F.col("ident")
    in_signature = F.coalesce(F.col("group_kw") == SIGNATURE, F.lit(False))
    define = ident & ((n1 == ":=") | ((n1 == ",") & (F.col("_next_stop") > F.col("i")))) \
        & ~(p1 == ".")
    typeish = F.col("n1_id") | n1.isin("*", "[", "...") | n1.isin(TYPE_WORDS)
    line_start = F.col("raw_prev").contains("\n") | (p1 == "(") | (p1 == ";")
    in_group = ident & line_start & F.col("group_kw").isin("var", "const", "type")
    is_param = in_signature & p1.isin("(", ",") & (typeish | ((n1 == ",") & F.col("named_group"))) \
        & ident & (tok != "_")
    kind = (F.when(~ident | (tok == "_"), F.lit(None))
            .when(p1 == "package", F.lit("PACKAGE"))
            .when((p1 == "func") | (in_method_name() & (F.col("depth") == 0)), F.lit("FUNC"))
            .when(p1 == "type", F.lit("TYPE"))
            .when(p1 == "var", F.lit("VAR"))
            .when(p1 == "const", F.lit("CONST"))
            .when((p1 == "import") & n1.startswith('"'), F.lit("PACKAGE"))
            .when(define, F.lit("VAR"))
            .when(in_group & (F.col("group_kw") == "var"), F.lit("VAR"))
            .when(in_group & (F.col("group_kw") == "const"), F.lit("CONST"))
            .when(in_group & (F.col("group_kw") == "type"), F.lit("TYPE"))
            .when(is_param, F.lit("VAR")))
    imp_path = F.when(tok.startswith('"'), T.path_base(T.unquote(tok)))
    is_import = tok.startswith('"') & (F.col("depth") == 0) & (
        (p1 == "import") | ((p1 == "(") & F.col("p2_import")) | p1.startswith('"'))
    kind = F.when(is_import, F.lit("PACKAGE")).otherwise(kind)
    a = a.withColumn("_kind", kind).withColumn("_typed", F.coalesce(
        F.col("_kind").isin("VAR", "CONST", "TYPE") & ~define, F.lit(False)))
    # The name that the last token before (stars aside) declares, if it does.
    w = Window.partitionBy(key, "sig").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    declared = F.last(F.when(~tok.isin("*", "..."), F.col("_typed")), ignorenulls=True).over(w)
    a = a.withColumn("_after_name", F.coalesce(declared, F.lit(False)))
    kind = F.col("_kind")
    name = F.when(is_import, imp_path).otherwise(tok)
    is_decl = kind.isNotNull()
    field = is_field(a)
    is_ref = ident & ~is_decl & ~(p1 == ".") & (tok != "_") & (~field | is_embedded(a)) & ~is_label()
    local = is_decl & ((F.col("depth") > 0) | is_param)
    header = define & F.col("in_header")
    # a parameter of a signature without body is visible nowhere after itself
    vis_end = (F.when(is_param, F.when(F.col("_body.has"), F.col("_body.end")).otherwise(F.col("end")))
               .when(header, F.col("_header_end")).otherwise(F.col("scope_end")))
    dtype = F.when(((kind == "VAR") & ~define) | (kind == "TYPE"), F.coalesce(
        "type_next", F.when((n1 == ",") & F.col("named_group"), F.col("run_type"))))
    return a.withColumns({
        "_is_decl": is_decl, "_is_ref": is_ref, "_name": name, "_local": local, "_vis_end": vis_end,
        "_type_pos": F.coalesce(ident & is_type_position(a), F.lit(False)), "_dtype": dtype})


def in_method_name():
    """The name between a receiver list and the parameters of a method."""
    return (F.col("p1") == ")") & (F.col("n1") == "(") & (F.col("q.closes") == SIGNATURE) \
        & ~F.col("raw_prev").contains("\n")


def is_embedded(a: DataFrame):
    """An embedded struct field: a type name alone on its line."""
    ends = F.col("raw_next").contains("\n") | F.col("n1").isin(";", "}")
    return is_field(a) & F.coalesce(ends, F.lit(False))


def is_type_position(a: DataFrame):
    """Places where an identifier is a type, by the tokens around it (``q``: the last token
    before it that is no ``*`` or ``...``)."""
    p1, n1 = F.col("p1"), F.col("n1")
    star = p1.isin("*", "...")
    same_line = ~F.coalesce(F.col("raw_prev").contains("\n"), F.lit(False))
    in_signature = F.coalesce(F.col("group_kw") == SIGNATURE, F.lit(False))
    in_struct = F.coalesce(F.col("scope_extra").rlike(r"(^| )struct$"), F.lit(False))
    return (
        # var a T, a *T, a, b T; named parameters, receivers and results; type A B
        (F.col("_after_name") & same_line)
        | F.col("type_led")
        # unnamed parameters and results, variadics
        | (in_signature & ~F.col("named_group") & F.col("q.t").isin("(", ","))
        | (in_signature & (p1 == "..."))
        # a single result
        | ((F.col("q.t") == ")") & (F.col("q.closes") == SIGNATURE) & same_line & ~in_method_name())
        # elements: []T, [N]T, map[K]V, keys, channels
        | ((p1 == "]") & same_line & (F.col("raw_prev") == "]"))
        | ((F.col("q.t") == "[") & (F.col("q.prev") == "map"))
        | (F.col("q.t") == "chan") | ((F.col("q.t") == "<-") & (F.col("q.prev") == "chan"))
        # struct fields: after the name, or embedded
        | (in_struct & F.coalesce(F.col("pgroup").isNull(), F.lit(True)) & same_line
           & F.col("q.id") & ~F.col("q.prev").isin("."))
        | is_embedded(a)
        # x.(T), make(T, new(T
        | ((F.col("q.t") == "(") & (F.col("q.prev") == "."))
        | ((F.col("q.t") == "(") & F.col("q.prev").isin("make", "new") & ~star)
        # a literal's type: no space before its brace
        | ((F.col("raw_next") == "{") & ~(p1 == "."))
        # The case labels of a type switch
        | (F.col("scope_extra").isin("type )") & F.col("q.t").isin("case", ",") & n1.isin(",", ":", ".")
           & F.col("pgroup").isNull()))


def type_after():
    """Type descriptor written after a declared name: ``T``, ``p.T``, ``*T``, ``[]T``
    (null when the next token does not start a type)."""
    n1, n2, n3, n4, n5 = (F.col(f"n{j}") for j in range(1, 6))

    def named(name, dot, member):
        return F.when(dot == ".", F.concat(name, dot, member)).otherwise(name)
    return (F.when(n1 == "*", F.concat(F.lit("*"), named(n2, n3, n4)))
            .when((n1 == "[") & (n2 == "]"), F.concat(F.lit("[]"), named(n3, n4, n5)))
            .when(F.col("n1_id"), named(n1, n2, n3))
            .when(n1 == "struct", n1))


def is_label():
    """Labels: ``L:`` starting a line, and the target of break/continue/goto.
    They live outside the scopes (no resolution, no diagnostics)."""
    line_start = F.col("raw_prev").contains("\n") | F.col("p1").isin("{", ";")
    return (F.col("sig") & F.col("ident")
            & ((line_start & (F.col("n1") == ":") & ~F.col("p1").isin("case"))
               | F.col("p1").isin("break", "continue", "goto")))


def is_field(a: DataFrame):
    """A name starting a line inside ``struct { ... }`` braces."""
    line_start = F.col("raw_prev").contains("\n") | F.col("p1").isin("{", ";")
    in_struct = F.coalesce(F.col("scope_extra").rlike("(^| )struct$"), F.lit(False))
    # the second name of ``a, b int`` too
    listed = (F.col("p1") == ",") & F.col("pgroup").isNull() & ~line_start
    return F.col("sig") & F.col("ident") & (line_start | listed) & in_struct


def go_builtins(spark) -> DataFrame:
    return spark.createDataFrame([(n, k) for k, n, _ in rules.BUILTINS], "name string, kind string")


def go_resolve(a: DataFrame, spark, key: str = "doc_id", items: DataFrame | None = None) -> DataFrame:
    """J2 for Go: local sweep, file tier, package tier (top-level names of the
    sibling files, when the files carry a package), builtin tier.
    ``decl_doc`` names the file of the declaration."""
    items = items if items is not None else go_items(a, key)
    has_pkg = "pkg" in items.columns
    r = resolve_refs(items, key, go_builtins(spark),
                     carry=["end", "type_pos"] + (["pkg"] if has_pkg else []))
    r = r.withColumn("decl_doc", F.when(F.col("tier").isin(0, 2), F.col(key)))
    if not has_pkg:
        return r
    # One row per (package, name): the first top-level declaration.  An equi
    # join on the package; only references the file could not resolve (or
    # resolved to a builtin, which a package name shadows) take it.
    top = items.filter("is_decl AND NOT local").groupBy("pkg", "name").agg(
        F.min(F.struct(F.col(key).alias("doc"), F.col("i").alias("i"),
                       F.col("kind").alias("kind"))).alias("_pd"))
    r = r.join(large(top), ["pkg", "name"], "left")
    r = r.withColumn("_use", (F.col("tier").isNull() | (F.col("tier") == 3))
                     & F.col("_pd").isNotNull())
    use = F.col("_use")
    return (r.withColumn("tier", F.when(use, F.lit(2)).otherwise(F.col("tier")))
            .withColumn("decl_i", F.when(use, F.col("_pd.i")).otherwise(F.col("decl_i")))
            .withColumn("decl_kind", F.when(use, F.col("_pd.kind")).otherwise(F.col("decl_kind")))
            .withColumn("decl_doc", F.when(use, F.col("_pd.doc")).otherwise(F.col("decl_doc")))
            .drop("_pd", "_use"))


def resolved_once(a: DataFrame, spark, key: str) -> tuple[DataFrame, DataFrame]:
    """Items and resolved references, stored: the rules that read them in several branches share
    one pass over the tokens (``a`` should be ``stored_tokens``; its items are then stored already)."""
    items = go_items(a, key)
    items = items if "_is_decl" in a.columns else stored(items, "items")
    return items, stored(go_resolve(a, spark, key, items), "resolved")


#: Words that start a statement and cannot stand inside parentheses but in a block.
STATEMENT_WORDS = ["if", "for", "switch", "select", "go", "defer", "return", "break", "continue", "goto",
                   "fallthrough", "case", "default", "package", "var", "const", "type"]


def go_brackets(a: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, beg, end, msg): parentheses and brackets without their partner.

    Braces bind stronger: brackets match among those directly in one brace scope, and start
    anew at a word that starts a statement, so an error does not spread further.  A closing
    bracket that nothing is open for is unexpected and opens no level; one that meets the
    other kind is reported, and takes its level's open one; what is open at the end is missing
    its partner.  Levels are running sums, so a scope of any size is one pass."""
    tok = F.col("tok")
    starts = F.col("sig") & F.col("raw_prev").contains("\n") & tok.isin(STATEMENT_WORDS)
    b = a.filter(F.col("sig") & (tok.isin("(", ")", "[", "]") | starts)).select(
        key, "i", "tok", "beg", "end", F.coalesce("scope_i", F.lit(-1)).alias("_in"),
        (~tok.isin("(", ")", "[", "]")).alias("_starts"))
    run = Window.partitionBy(key, "_in").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_st", F.sum(F.col("_starts").cast("int")).over(run)).filter("NOT _starts")
    part = [key, "_in", "_st"]
    w = Window.partitionBy(*part).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = tok.isin("(", "[")
    b = b.withColumn("_s", F.sum(F.when(opens, 1).otherwise(-1)).over(w))
    low = F.least(F.lit(0), F.min("_s").over(w))
    b = b.withColumn("_low", low).withColumn("_was", F.coalesce(F.lag("_low", 1).over(
        Window.partitionBy(*part).orderBy("i")), F.lit(0)))
    stray = ~opens & (F.col("_low") < F.col("_was"))
    b = b.withColumn("_stray", stray).withColumn("_level", F.col("_s") - F.col("_low") + F.when(opens, 0).otherwise(1))
    beside = Window.partitionBy(*part, "_level", "_stray").orderBy("i")
    b = b.withColumn("_next", F.lead("tok", 1).over(beside)).withColumn("_prev", F.lag("tok", 1).over(beside))
    closer = F.when(tok == "(", ")").when(tok == "[", "]")
    wanted = F.when(F.col("_prev") == "(", ")").otherwise("]")
    msg = (F.when(F.col("_stray"), F.format_string(rules.MSG_BRACKET_STRAY, tok))
           .when(opens & F.col("_next").isNull(), F.format_string(rules.MSG_BRACKET_OPEN, closer))
           .when(~opens & (wanted != tok), F.format_string(rules.MSG_BRACKET_EXPECTED, wanted, tok)))
    width = T.error_width(msg)
    return b.withColumn("msg", msg).filter(F.col("msg").isNotNull()).select(
        key, "beg", (F.col("beg") + width).cast("bigint").alias("end"), "msg")


def go_diagnostics(a: DataFrame, spark, key: str = "doc_id", include_values: bool = False) -> DataFrame:
    """X5 for Go: undefined types, values used as types, struct and pointer
    requirements, ``make()`` without a type argument, non-names left of
    ``:=``, bad import literals, unbalanced braces, parentheses and brackets.
    ``include_values``: undefined values too (J9).  ``(key, lvl, beg, end, msg)``."""
    items, r = resolved_once(a, spark, key)
    undefined = F.col("type_pos") & F.col("tier").isNull()
    not_type = F.col("type_pos") & F.col("tier").isNotNull() & ~F.col("decl_kind").isin("TYPE", "PACKAGE")
    msg = (F.when(undefined, F.format_string(rules.MSG_TYPE_UNDEFINED, F.col("name")))
           .when(not_type, F.lit(rules.MSG_TYPE_IDENT_REQUIRED)))
    if include_values:
        msg = F.coalesce(msg, F.when(~F.col("type_pos") & F.col("tier").isNull(),
                                     F.format_string(rules.MSG_VALUE_UNDEFINED, F.col("name"))))
    d1 = r.select(key, "beg", "end", msg.alias("msg")).filter(F.col("msg").isNotNull())
    make = a.filter("bare_make").select(
        key, "beg", "end", F.lit(rules.MSG_TYPE_ARG_REQUIRED).alias("msg"))
    unb = a.filter(F.col("kind").isNotNull() & ~F.col("matched")).select(
        key, "beg", "end", F.lit(rules.MSG_UNBALANCED).alias("msg"))
    # ':=' needs plain names on its left: a selector, index, call or deref
    # right before it is reported on the token before ':='
    bad_lhs = (F.col("sig") & (F.col("n1") == ":=")
               & (~F.col("ident") | F.col("p1").isin(".", "*", "&")))
    lhs = a.filter(bad_lhs).select(key, "beg", "end", F.lit(rules.MSG_IDENT_REQUIRED).alias("msg"))
    # import literals that do not unquote
    imp = a.filter(F.col("sig") & F.col("tok").startswith('"') & (F.col("depth") == 0)
                   & ((F.col("p1") == "import") | F.col("p2_import") | F.col("p1").startswith('"'))
                   & T.unquote(F.col("tok")).isNull()).select(
        key, "beg", "end", F.lit(rules.MSG_INVALID_PATH).alias("msg"))
    from .chains import go_chains  # it builds on this module
    mem = go_chains(a, spark, key, items, r).filter(F.col("msg").isNotNull()).select(
        key, F.col("x_beg").alias("beg"), F.col("x_end").alias("end"), "msg")
    d = d1.unionByName(make).unionByName(unb).unionByName(mem).unionByName(
        go_pointer_checks(a, spark, key, items, r)).unionByName(lhs).unionByName(imp).unionByName(go_brackets(a, key))
    return d.select(key, F.lit(rules.LVL_ERROR).alias("lvl"), "beg", "end", "msg")


def go_fontify(a: DataFrame, spark, key: str = "doc_id") -> DataFrame:
    """U2 for Go: base classes, declaration classes, and reference classes by
    the kind of the resolved declaration (unresolved values get no marker)."""
    items, resolved = resolved_once(a, spark, key)
    r = resolved.select(key, "i", "decl_kind")
    dk = items.filter("is_decl").select(key, "i", F.col("kind").alias("_dkind"))
    # members: a field found, or looked up in an open/unknown scope, is a Var;
    # a miss in a known struct gets no marker (as an unresolved value)
    mem = go_members(a, spark, key, items, resolved).select(
        key, F.col("sel_i").alias("i"), F.when(F.col("status") != "no_member", F.lit("VAR"))
        .alias("_mkind"))
    # Only names and literals can be declared or referred to; no other token is joined.
    base = go_base_class(F.col("tok"))
    t = a.select(key, "i", "tok", "beg", "end", base.alias("_base"), (F.col("ident") | F.col("tok").startswith('"')).alias(
        "_named"), is_label().alias("_label"), (is_field(a) & ~is_embedded(a)).alias("_field"))
    j = (t.filter("_named").join(large(dk), [key, "i"], "left").join(large(r), [key, "i"], "left")
         .join(large(mem), [key, "i"], "left")
         .withColumn("decl_kind", F.coalesce(F.col("decl_kind"), F.col("_mkind"))))
    def_cls = F.lit(None).cast("string")
    for k, c in KIND_DEF_CLASS.items():
        def_cls = F.when(F.col("_dkind") == k, F.lit(c)).otherwise(def_cls)
    ref_cls = F.lit(None).cast("string")
    for k, c in KIND_REF_CLASS.items():
        ref_cls = F.when(F.col("decl_kind") == k, F.lit(c)).otherwise(ref_cls)
    cls = (F.when(F.col("_label"), F.lit(rules.CLS_TYPE))
           .when(F.col("_field"), F.lit(rules.CLS_VAR_DEF))
           .when(F.col("_dkind").isNotNull() & ~F.col("tok").startswith('"'), def_cls)
           .when(F.col("_base") == rules.CLS_VAR, ref_cls)
           .otherwise(F.col("_base")))
    out = [key, "i", "tok", "beg", "end"]
    return j.select(*out, cls.alias("cls")).unionByName(
        t.filter("NOT _named").select(*out, F.col("_base").alias("cls"))).filter(F.col("cls").isNotNull())


KIND_PASS = ["TYPE", "CONST", "VAR", "FUNC"]


def go_file_env(a: DataFrame, key: str = "doc_id") -> DataFrame:
    """A5 + L3: top-level declarations in pass order (types, constants,
    variables, functions; packages first), the first one of each name kept."""
    items = go_items(a, key).filter(F.col("is_decl") & ~F.col("local"))
    rank = F.when(F.col("kind") == "PACKAGE", 0)
    for k, kind in enumerate(KIND_PASS, start=1):
        rank = rank.when(F.col("kind") == kind, k)
    w = Window.partitionBy(key, "name").orderBy("beg")
    first = items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return first.select(key, "name", "kind", "beg", rank.alias("pass_rank")).orderBy(
        key, "pass_rank", "beg")


def go_fields(a: DataFrame, key: str = "doc_id") -> DataFrame:
    """Struct members: (owner type, field, field type) per document."""
    owner = F.regexp_extract("scope_extra", r"^(\S+) struct$", 1)
    return a.filter(is_field(a)).select(key, owner.alias("owner"), F.col("tok").alias("field"),
                                        F.col("type_next").alias("ftype"))


def go_members(a: DataFrame, spark, key: str = "doc_id", items: DataFrame | None = None,
               resolved: DataFrame | None = None) -> DataFrame:
    """J5 for Go: ``x.sel`` -- declared type of ``x`` (in whichever file of the
    package declares ``x``), one pointer stripped, the named type's declaration
    (that file first, then the package), then ``sel`` among that struct's
    fields.  All left equi-joins.  Status found / no_member / struct_required /
    unknown (no declared type: ``:=``, package names, other packages -- the
    open scope of the reference, a miss there is silent)."""
    items = items if items is not None else go_items(a, key)
    resolved = resolved if resolved is not None else go_resolve(a, spark, key)
    has_pkg = "pkg" in items.columns
    res = resolved.select(key, F.col("i").alias("x_i"), "decl_i", "decl_doc",
                          F.col("beg").alias("x_beg"), F.col("end").alias("x_end"))
    decls = items.filter("is_decl").select(F.col(key).alias("decl_doc"), F.col("i").alias("decl_i"),
                                           "dtype")
    first_type = F.min(F.struct(F.col("i"), F.col("dtype"), F.col(key).alias("doc")))
    tfile = items.filter("is_decl AND kind = 'TYPE'").groupBy(
        F.col(key).alias("decl_doc"), F.col("name").alias("_t")).agg(first_type.alias("_tf"))
    fields = go_fields(a, key).select(F.col(key).alias("_tdoc"), F.col("owner").alias("_t"),
                                      F.col("field").alias("member"),
                                      F.lit(True).alias("_found")).distinct()
    sel_cols = [key, F.col("i").alias("sel_i"), F.col("tok").alias("member"), F.col("p2i").alias("x_i")]
    if has_pkg:
        sel_cols.append("pkg")
    sel = a.filter(F.col("sig") & F.col("ident") & (F.col("p1") == ".")).select(*sel_cols)
    j = (sel.join(large(res), [key, "x_i"]).join(large(decls), ["decl_doc", "decl_i"], "left")
         .withColumn("_t", T.type_strip_pointer(F.col("dtype")))
         .join(large(tfile), ["decl_doc", "_t"], "left"))
    if has_pkg:
        tpkg = items.filter("is_decl AND kind = 'TYPE' AND NOT local").groupBy(
            "pkg", F.col("name").alias("_t")).agg(first_type.alias("_tp"))
        j = j.join(large(tpkg), ["pkg", "_t"], "left")
        tdecl = F.coalesce(F.col("_tf"), F.col("_tp"))
    else:
        tdecl = F.col("_tf")
    j = (j.withColumn("base", tdecl.dtype).withColumn("_tdoc", tdecl.doc)
         .join(large(fields), ["_tdoc", "_t", "member"], "left"))
    builtin_types = [n for k, n, _ in rules.BUILTINS if k == "TYPE"]
    head = (F.when(F.col("_t").isin(builtin_types) | F.col("_t").startswith("[]"), F.col("_t"))
            .otherwise(F.col("base")))
    status = (F.when(F.col("dtype").isNull(), F.lit("unknown"))
              .when(F.col("_t").isin(builtin_types) | F.col("_t").startswith("[]"), F.lit("struct_required"))
              .when(F.col("base").isNull(), F.lit("unknown"))
              .when(F.col("base") != "struct", F.lit("struct_required"))
              .when(F.col("_found"), F.lit("found"))
              .otherwise(F.lit("no_member")))
    msg = F.when(status == "struct_required", F.format_string(rules.MSG_STRUCT_REQUIRED, head))
    return j.select(key, "sel_i", "member", F.col("_t").alias("owner"), status.alias("status"),
                    msg.alias("msg"), "x_beg", "x_end")


UNARY_AFTER = ["(", "[", "{", ",", ";", "=", ":=", "return", "+", "-", "*", "/", "==", "!=",
               "<", ">", "<=", ">=", "&&", "||", "!", ":", "<-"]


def go_pointer_checks(a: DataFrame, spark, key: str = "doc_id", items: DataFrame | None = None,
                      resolved: DataFrame | None = None) -> DataFrame:
    """``*x`` as an expression needs ``x`` of pointer type: a variable whose
    declared type is known and not a pointer gets "pointer type required"
    (unknown types stay silent, as Any does)."""
    star = a.filter(F.col("sig") & (F.col("tok") == "*") & F.col("n1_id")
                    & (F.col("p1").isNull() | F.col("p1").isin(UNARY_AFTER))).select(
        key, F.col("beg").alias("s_beg"), F.col("n1i").alias("x_i"))
    items = items if items is not None else go_items(a, key)
    resolved = resolved if resolved is not None else go_resolve(a, spark, key)
    res = resolved.select(
        key, F.col("i").alias("x_i"),
        F.when(F.col("decl_doc") == F.col(key), F.col("decl_i")).alias("decl_i"), "decl_kind",
        F.col("end").alias("x_end"))
    decls = items.filter("is_decl").select(key, F.col("i").alias("decl_i"), "dtype")
    j = star.join(large(res), [key, "x_i"]).join(large(decls), [key, "decl_i"], "left")
    bad = (F.col("decl_kind") == "VAR") & F.col("dtype").isNotNull() & ~F.col("dtype").startswith("*")
    return j.filter(bad).select(key, F.col("s_beg").alias("beg"), F.col("x_end").alias("end"),
                                F.lit(rules.MSG_POINTER_REQUIRED).alias("msg"))
