"""WARC archives: write pages as records, read them back by boundary-chain verification.

A record ends with CRLF CRLF and starts with the magic ``WARC/1.``.  Spark's text source
writes records byte for byte with the one as line separator, and with the other reads
archives in splits whose rows are the pieces between two magics, on any file system.  A
magic may also stand inside a payload or a header.  Every piece therefore only is a
*candidate*: it proposes the offset of its successor from its own header (header +
Content-Length + CRLF CRLF), which reaches over the pieces after it up to the first CRLF
CRLF.

Verification keeps what is reachable from offset 0 of each file.  Pieces whose successor
is the very next piece form runs; a run has one way out, the successor of its last piece.
Pointer jumping over the runs (reach doubles each round: reach |= J(reach), J = J o J)
finds the reachable ones in log2(runs) joins, and in each the offset where the chain
enters.  A file without traps has one run per split.  Unreachable pieces belong to the
header or block of the record that jumps over them, and are glued back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import materialize, salted_join

CRLF = "\r\n"
#: Starts a record; no suffix of it is a prefix of it, so no reader buffer can miss one.
MAGIC = "WARC/1."
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 8 groups of 20, 4 digits each."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0")
                        for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; a null value leaves the header out, CR and LF become %0D and %0A."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")),
                      F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def duplicate_heads(spark: SparkSession, pages: DataFrame, id_col: str, payload_col: str,
                    min_bytes: int) -> DataFrame:
    """(digest, head): for each payload of at least ``min_bytes`` that several rows hold,
    the least id among them.  One mergeable minimum per digest, so hot payloads are cheap."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    return materialize(spark, pages.filter(F.octet_length(payload) >= min_bytes)
                       .groupBy(F.unhex(F.sha1(payload)).alias("_digest"))
                       .agg(F.min(id_col).alias("_head"), F.count("*").alias("_n"))
                       .filter("_n > 1").drop("_n"), "heads")


def write_warc(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id",
               url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> str:
    """Write one record per row of ``pages`` under ``path`` (one archive per task).

    A response holds an HTTP header and the payload (null: empty).  Of rows with equal
    payloads of at least ``min_bytes`` the least id is the response; rows that repeat
    that id are responses too; all others are revisits without payload that name it.
    A null id revisits unless all ids of its payload are null.  Other columns are
    ignored; an empty table writes archives without records.  Returns ``path``."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_text"))
    heads = duplicate_heads(spark, rows, "_id", "_text", min_bytes)
    body = F.col("_text").cast("binary")
    rows = salted_join(rows.withColumn("_digest", F.unhex(F.sha1(body))), heads, ["_digest"],
                       "left", ["_id"])
    revisit = (F.octet_length(body) >= min_bytes) & F.col("_head").isNotNull() \
        & ~F.col("_id").eqNullSafe(F.col("_head"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                          "Content-Length: "), F.octet_length(body).cast("string"),
                    F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_text")))
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(
            F.col("_id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(body))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(
            F.lit("<urn:page:"), F.col("_head").cast("string"), F.lit(">"))),
            F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    rows.select(F.concat(header, block).alias("value")) \
        .write.option("lineSep", END).text(path)
    return path


def _named(header: Column, name: str, value: str = r"[^\r\n]*") -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*({value})", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, row, value): the bytes between two magics, in file order by (split, row)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value")


#: Payload bytes that the piece itself holds.
PAYLOAD = ("substring(cast(value as binary), cast(skip as int) + 1, "
           "cast(head + block_bytes - skip as int))")


def _facts(raw: DataFrame) -> DataFrame:
    """Header fields of each piece: header, block_bytes, head (bytes before the block), skip
    (bytes before the payload), http_bytes (the Content-Length inside an HTTP block)."""
    header = F.substring_index("value", END, 1)
    is_http = F.coalesce(_named(header, "Content-Type").startswith("application/http"), F.lit(False))
    http = F.when(is_http, F.substring_index(F.substring_index("value", END, 2), END, -1))
    head = F.octet_length(header).cast("long") + len(END)
    return raw.select(
        "*", header.alias("header"),
        _named(header, "Content-Length", r"\d{1,18}").cast("long").alias("block_bytes"),
        head.alias("head"),
        (head + F.when(is_http, F.octet_length(http) + len(END)).otherwise(0)).alias("skip"),
        _named(F.concat(F.lit(CRLF), http), "Content-Length", r"\d{1,18}").cast("long")
        .alias("http_bytes"))


def _inside() -> WindowSpec:
    """The pieces of a split that come before one."""
    return Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)


def _earlier() -> WindowSpec:
    """The splits of a file that come before one."""
    return Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def _offsets(rows: DataFrame) -> tuple[DataFrame, Column]:
    """((file, split, base), offset of a piece of ``rows`` joined with it).  A piece and the magic
    after it fill the split; prefix sums give absolute offsets, whatever the splits are."""
    filled = rows.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    bases = filled.select("file", "split", F.coalesce(F.sum("bytes").over(_earlier()), F.lit(0)).alias("base"))
    inside = F.sum(F.col("size") + len(MAGIC)).over(_inside())
    return bases, F.col("base") + F.coalesce(inside, F.lit(0)) - len(MAGIC)


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: file, offset, length, type, record_id, target_uri,
    refers_to, declared_digest, got (payload bytes in its block), http_bytes, digest.

    The digest is that of the payload bytes read back.  A chain ends at the first record
    without a readable Content-Length, which is not returned; neither is what follows.
    A record that the end of the file cuts short is returned with the bytes there are.
    Archives without records give none."""
    before = _inside()
    facts = _facts(pieces(spark, path))
    slim = materialize(spark, facts.select(
        "file", "split", "row", "header", "block_bytes", "head", "skip", "http_bytes",
        (~F.contains("value", F.lit(END))).alias("open"),
        F.octet_length("value").cast("long").alias("size"),
        F.octet_length(F.expr(PAYLOAD)).cast("long").alias("got"),
        base32_sha1(F.expr(PAYLOAD)).alias("digest")), "pieces")
    bases, offset = _offsets(slim)
    closed = F.when(F.col("open"), 0).otherwise(1)
    before_split = slim.groupBy("file", "split").agg(F.sum(closed).alias("closed")).select(
        "file", "split", F.coalesce(F.sum("closed").over(_earlier()), F.lit(0)).alias("ends"))
    bases = bases.join(before_split, ["file", "split"])
    # A piece starts after its magic; what stands before a file's first magic is no candidate.
    # Pieces up to and with the next one that holds a header's end have the same ``ends``.
    steady = (F.col("head") + F.col("block_bytes") + len(END)).eqNullSafe(F.col("size"))
    run = F.coalesce(F.sum(F.when(F.col("steady"), 0).otherwise(1)).over(before), F.lit(0))
    ends = F.col("ends") + F.coalesce(F.sum(closed).over(before), F.lit(0))
    cand = slim.withColumn("steady", steady).join(bases, ["file", "split"]).withColumn(
        "offset", offset).withColumn("run", run).withColumn("ends", ends).filter(
        "offset >= 0").withColumn(
        "length", F.col("head") + F.col("block_bytes") + len(MAGIC) + len(END)).withColumn(
        "succ", F.col("offset") + F.col("length")).drop("base", "size")
    cand = _long_headers(spark, materialize(spark, cand, "candidates"))
    runs = cand.groupBy("file", "split", "run").agg(
        F.min("offset").alias("start"), F.max(F.struct("offset", "succ"))["succ"].alias("out"))
    landing = cand.select("file", F.col("offset").alias("out"),
                          F.struct("split", "run").alias("to"))
    # Rows of pieces compress so well that their files look small enough to send around.
    runs = materialize(spark, runs.join(landing.hint("merge"), ["file", "out"], "left").select(
        "file", F.struct("split", "run").alias("node"), "to", "start", "out"), "runs")
    entries = _reachable(spark, runs).select(
        "file", "entry", F.col("node.split").alias("split"), F.col("node.run").alias("run"))
    kept = cand.join(entries, ["file", "split", "run"]).filter(
        "offset >= entry and block_bytes is not null").drop("entry")
    torn = F.col("open") | (F.col("got") < F.col("head") + F.col("block_bytes") - F.col("skip"))
    whole = kept.filter(~torn).select(*RECORD)
    glued = _glued(spark, path, cand, materialize(spark, kept.filter(torn), "torn"))
    return whole.unionByName(glued).select(
        "file", "offset", "length", "got", "http_bytes", "digest",
        *[_named(F.col("header"), h).alias(c) for h, c in (
            ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"),
            ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
            ("WARC-Payload-Digest", "declared_digest"))])


#: What a verified record keeps of its pieces.
RECORD = ["file", "offset", "length", "header", "got", "http_bytes", "digest"]


def _long_headers(spark: SparkSession, cand: DataFrame) -> DataFrame:
    """``cand`` with head, block_bytes, length and succ of headers that hold magics.

    No magic overlaps a CRLF CRLF or a Content-Length line, so both lie whole in one piece:
    an open piece takes the first length at or after it up to the header's end.  A record
    ends with CRLF CRLF, so the pieces of one such group are no more than one record."""
    groups = cand.filter("open").select("file", "ends").distinct()
    if groups.isEmpty():
        return cand
    # Backwards, so that the frame only grows.
    rest = Window.partitionBy("file", "ends").orderBy(F.desc("offset")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = F.struct("offset", "head")
    mended = cand.join(groups, ["file", "ends"], "left_semi").withColumn(
        "block_bytes", F.last("block_bytes", True).over(rest)).withColumn(
        "head", F.max(last).over(rest)["offset"] - F.col("offset") + F.max(last).over(rest)["head"]
    ).withColumn("length", F.col("head") + F.col("block_bytes") + len(MAGIC) + len(END)).withColumn(
        "succ", F.col("offset") + F.col("length"))
    return materialize(spark, cand.join(groups, ["file", "ends"], "left_anti").unionByName(mended),
                       "mended")


def _reachable(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """(file, node, entry): runs that the chain from offset 0 passes, and where it enters.

    Pointer jumping: after round k the first 2^k runs of each file's chain are known."""
    reach = runs.filter("start = 0").select("file", "node")
    jump = runs.filter("to is not null").select("file", "node", "to")
    longest = jump.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        ahead = reach.join(jump, ["file", "node"]).select("file", F.col("to").alias("node"))
        reach = materialize(spark, reach.union(ahead).distinct(), "reach")
        jump = materialize(spark, jump.alias("a").join(
            jump.alias("b"), (F.col("a.file") == F.col("b.file"))
            & (F.col("a.to") == F.col("b.node"))).select(
            F.col("a.file").alias("file"), F.col("a.node").alias("node"),
            F.col("b.to").alias("to")), "jump")
    entered = reach.join(runs, ["file", "node"]).filter("to is not null").select(
        "file", F.col("to").alias("node"), F.col("out").alias("entry"))
    return entered.union(runs.filter("start = 0").select("file", "node", F.lit(0).alias("entry")))


def _glued(spark: SparkSession, path: str, cand: DataFrame, torn: DataFrame) -> DataFrame:
    """RECORD of ``torn`` (records whose header or block holds magics), from all their bytes.

    Only the files that hold such records are read a second time.  That scan may have other
    splits than the first, so a piece is known by its offset in the file.  Verified records do
    not overlap: the owner of a piece is the last torn record at or before it, found split by
    split, with what earlier splits leave open carried over."""
    if torn.isEmpty():
        return torn.select(*RECORD)
    files = torn.select("file").distinct()
    ends = torn.select("file", "offset", F.struct(F.col("offset").alias("at"), "succ").alias("own"))
    near = cand.join(files, "file", "left_semi").join(ends, ["file", "offset"], "left")
    carried = near.groupBy("file", "split").agg(F.max("own").alias("own")).select(
        "file", "split", F.last("own", True).over(_earlier()).alias("carried"))
    here = F.last("own", True).over(Window.partitionBy("file", "split").orderBy("offset"))
    owned = near.withColumn("own", here).join(carried, ["file", "split"]).withColumn(
        "own", F.coalesce("own", "carried")).filter("offset < own.succ").select(
        "file", "offset", F.col("own.at").alias("at"))
    again = materialize(spark, pieces(spark, path).join(files, "file", "left_semi"), "again")
    sized = again.select("file", "split", "row", F.octet_length("value").cast("long").alias("size"))
    bases, offset = _offsets(sized)
    places = sized.join(bases, ["file", "split"]).select("file", "split", "row", offset.alias("offset"))
    parts = again.join(places.join(owned.hint("merge"), ["file", "offset"]).hint("merge"),
                       ["file", "split", "row"])
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))),
                                     lambda x: x["value"]), MAGIC)
    whole = parts.groupBy("file", F.col("at").alias("offset")).agg(value.alias("value"))
    return torn.select("file", "offset", "length").join(_facts(whole), ["file", "offset"]).withColumn(
        "got", F.octet_length(F.expr(PAYLOAD)).cast("long")).withColumn(
        "digest", base32_sha1(F.expr(PAYLOAD))).select(*RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every verified record: record_id, record_type, target_uri, file, offset, length,
    payload_bytes, payload_digest, refers_to, digest_ok.  A response's bytes and digest are
    of the payload read back; a revisit's are its response's, from its own headers."""
    revisit = F.col("type") == "revisit"
    declared = F.regexp_replace("declared_digest", "^sha1:", "")
    return warc_index(spark, path).select(
        "record_id", F.col("type").alias("record_type"), "target_uri", "file", "offset", "length",
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("got")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("digest")).alias("payload_digest"),
        "refers_to", (revisit | declared.eqNullSafe(F.col("digest"))).alias("digest_ok"))


def page_number(record: Column) -> Column:
    """The page id in ``<urn:page:N>``; null where there is none."""
    return F.nullif(F.regexp_extract(record, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
