"""The editor protocol as one DataFrame job: a table of command lines and a
scanned corpus in, the protocol's output lines out.

    process_commands(cmds(seq, line), corpus(path, dir, name, text))
        -> (seq, line_no, line)

Commands: ``go-root`` / ``go-path`` (settings, last write before a command
wins), ``load-project`` (dirs found), ``analyze [-n N] file`` (ERRORS-CLEAR and
an ERRORS block), ``complete file pos`` (COMPLETE block), ``find-files pfx
system|x max`` (FILES block), ``file-in-project path`` (SET-/DROP-FILE-MODE),
``quit`` (later commands are ignored), ``tooltip-info`` (accepted, no
output); unknown commands and missing arguments give a MESSAGE.  ``$GOROOT``/``$GOPATH`` in file arguments expand from the
settings.  Everything is joins, windows and aggregates over the two tables; only
the requested files are analysed (left-semi on the request paths).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators.asof import asof_latest
from ..operators.choices import ranked
from ..operators.topk import first_per_key
from ..operators.numbering import dense_number
from ..operators.gosrc import go_builtins, go_diagnostics, go_fontify, go_items, go_tokens
from ..session import ensure_checkpoint_dir
from ..sources.catalog import all_dirs, lookup_source
from ..sources.commands import keep_command_line, parse_commands
from ..sources.sinks import tee_batch
from .edits import fold_edits
from .routes import command_rules, validate_commands

LINES = "seq long, line_no long, line string"


def _q(c: Column) -> Column:
    return T.quote_ascii(c)


def _lines(df: DataFrame, *items: tuple[Column, Column]) -> DataFrame:
    """Fixed lines per row of ``df``: (line_no, text) pairs via one explode."""
    arr = F.array(*[F.struct(n.cast("bigint").alias("n"), t.alias("t")) for n, t in items])
    return df.select("seq", F.explode(arr).alias("_l")).select(
        "seq", F.col("_l.n").alias("line_no"), F.col("_l.t").alias("line"))


def _message(df: DataFrame, msg: Column) -> DataFrame:
    return _lines(df, (F.lit(0), F.concat(F.lit("MESSAGE "), _q(msg))),
                  (F.lit(1), F.lit("MESSAGE-END")), (F.lit(2), F.lit("")))


def _numbered(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    """Rows of one block per ``seq`` numbered from ``start`` in ``order``."""
    w = Window.partitionBy("seq").orderBy(*order)
    return rows.select("seq", (F.row_number().over(w) + F.lit(start - 1)).cast("bigint")
                       .alias("line_no"), F.col("row").alias("line"))


def _with_settings(c: DataFrame) -> DataFrame:
    """GOROOT / GOPATH in force at every command (as-of the last write)."""
    out = c
    for var, cmd in (("GOROOT", "go-root"), ("GOPATH", "go-path")):
        ev = c.select("seq", F.lit(0).alias("_s"), "name",
                      F.try_element_at("args", F.lit(1)).alias("value"))
        m = asof_latest(ev, "_s", "seq", F.col("name") == cmd, F.lit(True), ["value"])
        out = out.join(m.select("seq", F.col("match.value").alias(var)), "seq", "left")
    return out


def before_quit(c: DataFrame, with_quit: bool = False) -> DataFrame:
    """Nothing after the first quit runs (its number is a one-row table, broadcast)."""
    q = c.filter(F.col("name") == "quit").groupBy(F.lit(1).alias("_k")).agg(
        F.min("seq").alias("_quit"))
    runs = F.col("seq") <= F.col("_quit") if with_quit else F.col("seq") < F.col("_quit")
    return (c.withColumn("_k", F.lit(1)).join(F.broadcast(q), "_k", "left")
            .filter(F.col("_quit").isNull() | runs).drop("_k", "_quit"))


def process_commands(cmds: DataFrame, corpus: DataFrame, codeblocks: bool = False) -> DataFrame:
    """``codeblocks``: also emit a FONTIFY block after each ERRORS block."""
    spark = cmds.sparkSession
    c = parse_commands(cmds.filter(keep_command_line(F.col("line"))))
    c = before_quit(c)
    v = validate_commands(c, command_rules(spark))
    out = [_message(v.filter(F.col("status") != "ok"), F.col("msg"))]
    ok = _with_settings(v.filter(F.col("status") == "ok").drop("min_args", "status", "msg"))
    env = F.create_map(F.lit("GOROOT"), T.setting_default(F.col("GOROOT"), F.lit("")),
                       F.lit("GOPATH"), T.setting_default(F.col("GOPATH"), F.lit("")))
    # The command table is small and read by every branch below: materialise
    # it once in the checkpoint folder so the branches share it (and the plan
    # stays a plan, not a copy of the lineage per branch).
    ensure_checkpoint_dir(spark)
    ok = ok.withColumn("file", T.expand_vars(F.try_element_at("args", F.lit(1)), env)).checkpoint()
    files = corpus.select("path", "dir", "name", "text")

    # load-project: every directory of the tree, those without files of their own included.
    n_dirs = all_dirs(corpus).groupBy(F.lit(1).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    lp = ok.filter(F.col("name") == "load-project").withColumn("_k", F.lit(1)).join(
        F.broadcast(n_dirs), "_k", "left")
    out.append(_message(lp, F.format_string(rules.MSG_DIRS_FOUND, F.coalesce("_n", F.lit(0)))))

    # file-in-project
    fm = ok.filter(F.col("name") == "file-in-project").withColumn(
        "file", F.try_element_at("args", F.lit(1)))          # not expanded
    mode = T.file_mode(F.col("file"))
    out.append(_lines(fm, (F.lit(0), F.concat(mode, F.lit(" "), _q(F.col("file")))),
                      (F.lit(1), F.concat(mode, F.lit("-END"))), (F.lit(2), F.lit(""))))

    # find-files: prefix match as an equality on exploded name prefixes.
    ff = ok.filter(F.col("name") == "find-files").select(
        "seq", F.try_element_at("args", F.lit(1)).alias("pfx"), (F.try_element_at("args", F.lit(2)) == "system")
        .alias("system"), T.atoi(F.try_element_at("args", F.lit(3))).alias("max"))
    # Only prefixes that some command asks for, each answered once: its first ``max`` paths
    # (a rank that is cut at the largest request), then one join back to the commands.
    asked = ff.groupBy("pfx").agg(F.max("max").alias("_most"))
    lens = asked.agg(F.collect_set(F.length("pfx")).alias("_lens"))  # lengths, not prefixes
    pre = files.select("path", "name").withColumn("_lens", lens.scalar()).withColumn("_len", F.explode(
        F.filter("_lens", lambda k: k <= F.length("name")))).select("path", F.expr("substring(name, 1, _len)").alias("pfx"))
    hits = first_per_key(pre.join(asked, "pfx"), "pfx", ["path"], F.col("_most"), "_r")
    kept = ff.join(hits, "pfx").filter(F.col("_r") <= F.col("max"))
    body = kept.select("seq", F.col("_r").cast("bigint").alias("line_no"),
                       F.concat(F.lit("  "), _q(F.col("path"))).alias("line"))
    cnt = kept.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"))
    fr = ff.join(cnt, "seq", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    hdr = F.concat(F.lit("FILES "), F.when(F.col("system"), _q(F.lit("system")))
                   .otherwise(_q(F.lit("non-system"))))
    out += [body, _lines(fr, (F.lit(0), hdr), (F.col("_n") + 1, F.lit("FILES-END")),
                         (F.col("_n") + 2, F.lit("")))]

    # analyze / complete (expanded path) and changed / reload (raw path): look
    # the file up (J1); a missing one is a MESSAGE.
    req = ok.filter(F.col("name").isin("analyze", "complete", "changed", "reload")).select(
        "seq", "no", "name", F.when(F.col("name").isin("analyze", "complete"), F.col("file"))
        .otherwise(F.try_element_at("args", F.lit(1))).alias("path"), "args")
    found = lookup_source(req, files)
    out.append(_message(found.filter(F.col("status") != "ok"), F.col("msg")))
    good = found.filter(F.col("status") == "ok").select("seq", "no", "name", "path", "args")
    # Text versions: ``reload`` starts a new epoch (unsaved edits dropped),
    # every ``changed`` is one more splice inside it; a request sees the
    # version (path, epoch, edits so far).  Running counts per path.
    wp = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    good = good.withColumn("_epoch", F.sum((F.col("name") == "reload").cast("int")).over(wp))
    wk = Window.partitionBy("path", "_epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    good = good.withColumn("_k", F.sum((F.col("name") == "changed").cast("int")).over(wk))
    good = good.withColumn("vkey", F.concat_ws("#", "path", F.col("_epoch").cast("string"),
                                               F.col("_k").cast("string"))).checkpoint()
    edits = good.filter(F.col("name") == "changed").select(
        "path", "_epoch", F.col("_k").alias("_rank"), "seq",
        T.atoi(F.try_element_at("args", F.lit(3))).alias("beg"),
        T.atoi(F.try_element_at("args", F.lit(4))).alias("end"),
        F.try_element_at("args", F.lit(2)).alias("new_text"))
    versions = good.filter(F.col("name").isin("analyze", "complete")).select(
        "vkey", "path", "_epoch", "_k").distinct()
    if versions.isEmpty():      # a tiny job on the checkpointed command rows
        return reduce(DataFrame.unionByName, out)
    disk = files.select("path", F.encode("text", "UTF-8").alias("bin"))
    base = versions.join(disk, "path").select("vkey", "bin")
    # only the requested versions are folded: a version's edits are the first
    # k of its epoch (T1 over a bounded, per-version edit list)
    ve = versions.join(edits, ["path", "_epoch"]).filter(F.col("_rank") <= F.col("_k"))
    folded = fold_edits(ve.select("vkey", "seq", "beg", "end", "new_text"), "vkey", base)
    current = (base.join(folded.select("vkey", F.col("bin").alias("_new")), "vkey", "left")
               .select("vkey", T.as_text(F.coalesce("_new", "bin")).alias("text")))
    # Tokens of the requested versions only, materialised once for the
    # diagnostics and completion branches.
    a = go_tokens(current.withColumnRenamed("vkey", "doc_id"), "doc_id", "text").checkpoint()
    good = good.filter(F.col("name").isin("analyze", "complete"))

    an = good.filter(F.col("name") == "analyze")
    d = go_diagnostics(a, spark).withColumnRenamed("doc_id", "vkey")
    rows = an.join(d, "vkey").withColumn("row", F.concat_ws(
        " ", F.lit(" "), F.col("lvl"), F.col("beg").cast("string"), F.col("end").cast("string"),
        _q(F.col("msg"))))
    out.append(_numbered(rows, [F.col("beg"), F.col("end"), F.col("row")], 4))
    cnt = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"))
    fr = an.join(cnt, "seq", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    out.append(_lines(fr, (F.lit(0), F.lit("ERRORS-CLEAR ")), (F.lit(1), F.lit("ERRORS-CLEAR-END")),
                      (F.lit(2), F.lit("")),
                      (F.lit(3), F.concat_ws(" ", F.lit("ERRORS"), _q(F.col("path")),
                                             F.col("no").cast("string"))),
                      (F.col("_n") + 4, F.lit("ERRORS-END")), (F.col("_n") + 5, F.lit(""))))

    if codeblocks:
        out += _fontify(spark, an, fr.select("seq", "_n"), a, current)
    out += _complete(spark, good.filter(F.col("name") == "complete"), a)
    return reduce(DataFrame.unionByName, out)


def _fontify(spark, an: DataFrame, errs: DataFrame, a: DataFrame, files: DataFrame) -> list[DataFrame]:
    """``FONTIFY "file" "file" no 0 size`` then ``  Class beg end`` rows,
    placed after the ERRORS block of the same command."""
    spans = go_fontify(a, spark).withColumnRenamed("doc_id", "vkey")
    rows = an.join(spans, "vkey").withColumn("row", F.concat_ws(
        " ", F.lit(" "), F.col("cls"), F.col("beg").cast("string"), F.col("end").cast("string")))
    base = an.join(errs, "seq").withColumn("_b", F.col("_n") + 6)      # after ERRORS-END + blank
    body = _numbered(rows, [F.col("beg"), F.col("end"), F.col("row")], 1)
    body = body.join(base.select("seq", "_b"), "seq").select(
        "seq", (F.col("line_no") + F.col("_b")).alias("line_no"), "line")
    cnt = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("_m"))
    size = files.select("vkey", F.octet_length("text").alias("_size"))
    fr = base.join(cnt, "seq", "left").join(size, "vkey").withColumn(
        "_m", F.coalesce("_m", F.lit(0)))
    head = F.concat_ws(" ", F.lit("FONTIFY"), _q(F.col("path")), _q(F.col("path")),
                       F.col("no").cast("string"), F.lit("0"), F.col("_size").cast("string"))
    return [body, _lines(fr, (F.col("_b"), head), (F.col("_b") + F.col("_m") + 1, F.lit("FONTIFY-END")),
                         (F.col("_b") + F.col("_m") + 2, F.lit("")))]


def _complete(spark, cm: DataFrame, a: DataFrame) -> list[DataFrame]:
    """J10 for one cursor per command: the identifier containing the cursor
    (both ends inclusive), its prefix up to the cursor, and every visible
    declaration (local, file, builtin) starting with it -- newest local first."""
    cur = cm.select("seq", "vkey", T.atoi(F.try_element_at("args", F.lit(2))).alias("pos"))
    ids = a.filter(F.col("sig") & F.col("tok").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
                   & ~F.col("tok").isin(rules.GO_KEYWORDS)).select(
        F.col("doc_id").alias("vkey"), F.col("beg").alias("ibeg"), F.col("end").alias("iend"),
        F.col("tok").alias("ident"))
    # The identifier at a cursor is the last one that begins at or before it: one sweep.
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ibeg", "bigint"), ("iend", "bigint"), ("ident", "string"))]
    ev = ids.select("vkey", F.lit(None).cast(cur.schema["seq"].dataType).alias("seq"), F.lit(None).cast("int").alias("pos"),
                    "ibeg", "iend", "ident", F.struct(F.col("ibeg").cast("bigint").alias("p"), F.lit(0).alias("t")).alias("_e")) \
        .unionByName(cur.select("vkey", "seq", "pos", *none, F.struct(
            F.col("pos").cast("bigint").alias("p"), F.lit(1).alias("t")).alias("_e")))
    sweep = Window.partitionBy("vkey").orderBy("_e.p", "_e.t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("ident").isNotNull(), F.struct("ibeg", "iend", "ident")), ignorenulls=True).over(sweep)
    hit = ev.withColumn("_id", last).filter(F.col("seq").isNotNull()).select(
        "vkey", "seq", "pos", "_id.ibeg", "_id.iend", "_id.ident").filter("pos <= iend")
    hit = hit.withColumn("pref", F.substring("ident", 1, F.col("pos") - F.col("ibeg")))
    # The names with a prefix are a range of ranks, and a range is a few blocks of ranks.
    decls = go_items(a).filter("is_decl").select(
        F.col("doc_id").alias("vkey"), "name", "kind", F.col("beg").alias("dbeg"), "local", "vis_end")
    decls, asked = ranked(decls, hit, "vkey")
    decls = decls.withColumn("_size", F.explode(F.sequence(F.lit(0), F.length(F.bin("names")) - 1))).withColumn(
        "_block", F.expr("shiftright(rank, _size)").cast("bigint")).withColumnRenamed("name", "choice")
    asked = asked.withColumn("_b", F.explode("blocks")).select(
        *hit.columns, F.col("_b.size").alias("_size"), F.col("_b.block").alias("_block"))
    vis = (F.col("dbeg") < F.col("pos")) & (F.col("vis_end").isNull() | (F.col("pos") < F.col("vis_end")))
    loc = asked.join(decls, ["vkey", "_size", "_block"]).filter(~F.col("local") | vis)
    loc = loc.withColumn("_tier", F.when(F.col("local"), 0).otherwise(2))
    b = go_builtins(spark).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring(
        "name", 1, k))).alias("pref"), F.col("name").alias("choice"), "kind")
    # the builtin table is fixed (30 names, a few hundred prefixes): broadcast
    bl = hit.join(F.broadcast(b), "pref").withColumn(
        "_tier", F.lit(3)).withColumn("dbeg", F.lit(None).cast("bigint"))
    cols = ["seq", "choice", "kind", "_tier", "dbeg", "ibeg"]
    ch = loc.select(*cols).unionByName(bl.select(*cols))
    ch = ch.withColumn("row", F.concat_ws(" ", F.lit(" "), T.kind_label(F.col("kind")),
                                          _q(F.col("choice")), _q(F.col("choice")),
                                          F.col("ibeg").cast("string"),
                                          (F.col("ibeg") + F.octet_length("choice")).cast("string")))
    body = _numbered(ch, [F.col("_tier"), F.desc("dbeg"), F.col("choice")], 1)
    cnt = ch.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"))
    fr = hit.join(cnt, "seq", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    head = F.concat_ws(" ", F.lit("COMPLETE"), _q(F.col("ident")), F.col("ibeg").cast("string"),
                       F.col("iend").cast("string"), _q(F.col("pref")))
    return [body, _lines(fr, (F.lit(0), head), (F.col("_n") + 1, F.lit("COMPLETE-END")),
                         (F.col("_n") + 2, F.lit("")))]


SETTING_CMDS = ["go-root", "go-path"]


def command_stream_batch(batch: DataFrame, batch_id: int, corpus: DataFrame, out_path: str,
                         state_path: str, log_in: str | None = None,
                         log_out: str | None = None) -> None:
    """``foreachBatch`` step.  The state before the batch -- the setting commands in force,
    the unsaved ``changed`` edits of each file and the first ``quit``, as numbered lines --
    is replayed ahead of it with negative sequence numbers.  Output, logs and the new state
    go to folders of this batch id, so a batch that is run again replaces its own result.
    Only batch 0 starts without a state; one that cannot be read fails the step."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    mine = f"batch={batch_id}"
    prior = spark.createDataFrame([], "no long, line string") if batch_id == 0 else (
        spark.read.schema("no long, line string").parquet(f"{state_path}/batch={batch_id - 1}"))
    n = prior.count()
    cmds = prior.select((F.col("no") - F.lit(n)).alias("seq"), "line").unionByName(
        batch.select("seq", "line")).checkpoint()
    lines = process_commands(cmds, corpus).filter(F.col("seq") >= 0).checkpoint()
    lines.write.mode("overwrite").parquet(f"{out_path}/{mine}")
    if log_in and log_out:   # S6: raw input lines and rendered output as text logs
        tee_batch(batch, f"{log_in}/{mine}", f"{log_out}/{mine}",
                  lambda b: lines.orderBy("seq", "line_no").select(F.col("line").alias("value")))
    parsed = validate_commands(before_quit(parse_commands(cmds.filter(keep_command_line(
        F.col("line")))), with_quit=True), command_rules(spark)).filter(F.col("status") == "ok")
    last = (parsed.filter(F.col("name").isin(SETTING_CMDS))
            .groupBy("name").agg(F.max(F.struct("seq", "line")).alias("_w"))
            .select(F.col("_w.seq").alias("seq"), F.col("_w.line").alias("line")))
    # unsaved edits: per file, the ``changed`` commands after its last reload
    files = parsed.filter(F.col("name").isin("changed", "reload")).withColumn(
        "_path", F.try_element_at("args", F.lit(1)))
    reloads = files.filter(F.col("name") == "reload").groupBy("_path").agg(
        F.max("seq").alias("_r"))
    pending = (files.filter(F.col("name") == "changed").join(reloads, "_path", "left")
               .filter(F.col("_r").isNull() | (F.col("seq") > F.col("_r")))
               .select("seq", "line"))
    ended = parsed.filter(F.col("name") == "quit").select("seq", "line")
    kept = dense_number(last.unionByName(pending).unionByName(ended), [F.col("seq"), F.col("line")],
                        "no", 0)
    kept.select("no", "line").write.mode("overwrite").parquet(f"{state_path}/{mine}")


def command_stream(cmds: DataFrame, corpus: DataFrame, out_path: str, state_path: str,
                   checkpoint: str, trigger: dict | None = None, log_in: str | None = None,
                   log_out: str | None = None):
    """Structured Streaming form of :func:`process_commands`; ``cmds`` is a
    stream of ``(seq, line)``.  ``log_in``/``log_out``: text logs of the
    input lines and of the output (S6)."""
    w = (cmds.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: command_stream_batch(b, i, corpus, out_path, state_path,
                                                         log_in, log_out)))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
