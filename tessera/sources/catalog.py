"""Files, directory tree, packages and source lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def scan_corpus(spark: SparkSession, roots: list[str] | str, glob: str = "*.go") -> DataFrame:
    """Every file below the roots as (path, dir, name, text, root).

    ``binaryFile`` lists and reads files in parallel tasks; content is decoded
    as UTF-8 without failing on bad bytes."""
    def below(root: str) -> DataFrame:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", glob).load(root).withColumn("root", F.lit(root)))
    df = reduce(DataFrame.unionByName, map(below, [roots] if isinstance(roots, str) else roots))
    path = F.regexp_replace("path", "^file:", "")
    return df.select(path.alias("path"), T.path_dir(path).alias("dir"), T.path_file(path).alias("name"),
                     T.as_text(F.col("content")).alias("text"),
                     F.regexp_replace("root", "^file:", "").alias("root"))


def file_table(documents: DataFrame) -> DataFrame:
    """Binding of ``documents`` as files: dir = source/lang, name = doc_id."""
    d = F.concat_ws("/", "source", "lang")
    n = F.col("doc_id").cast("string")
    return documents.select("doc_id", "source", "lang", d.alias("dir"), n.alias("name"),
                            F.concat_ws("/", d, n).alias("path"),
                            F.octet_length("text").alias("size"))


def packages(files: DataFrame) -> DataFrame:
    """S3: one package per directory.  The file list itself stays in the file
    table (a directory may hold a large share of all files); the package row
    keeps count, first and last name and bytes."""
    return files.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("name").alias("first_name"),
        F.max("name").alias("last_name"), F.sum("size").cast("bigint").alias("n_bytes"))


def all_dirs(files: DataFrame) -> DataFrame:
    """Every directory from a file's root (column ``root``; without one, its first
    element) down to the file, itself holding files or not, once."""
    def parts(c: str) -> Column:
        return F.filter(F.split(c, "/"), lambda s: s != "")
    root = F.size(parts("root")) if "root" in files.columns else F.lit(1)
    tops = files.select("dir", F.greatest(root, F.lit(1)).alias("_top")).distinct()
    pre = tops.select(parts("dir").alias("p"), "_top").filter(F.size("p") >= F.col("_top")).select(
        F.explode(F.transform(F.sequence(F.col("_top"), F.size("p")),
                              lambda k: F.array_join(F.slice("p", 1, k), "/"))).alias("dir"))
    return pre.distinct()


#: Partitions that the misses of one directory are dealt over.
MISS_SALTS = 8


def lookup_source(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Split each requested path, find the package by directory and the
    file by name (two left joins), with the two protocol messages."""
    req = requests.withColumn("_dir", T.path_dir(F.col("path"))).withColumn(
        "_name", T.path_file(F.col("path")))
    fl = files.select(F.col("dir").alias("_dir"), F.col("name").alias("_name"),
                      F.lit(True).alias("_src"))
    # The join on (dir, name) answers hits; only a miss also asks for its directory, by a key
    # that is null on hits and salted, so a directory with most requests is no single task.
    pk = files.select(F.col("dir").alias("_miss")).distinct().select(
        "_miss", F.explode(F.sequence(F.lit(0), F.lit(MISS_SALTS - 1))).alias("_salt"),
        F.lit(True).alias("_pk"))
    j = req.join(fl, ["_dir", "_name"], "left") \
        .withColumn("_miss", F.when(F.col("_src").isNull(), F.col("_dir"))) \
        .withColumn("_salt", F.pmod(F.xxhash64("_name"), F.lit(MISS_SALTS)).cast("int")) \
        .join(pk, ["_miss", "_salt"], "left").withColumn("_pk", F.coalesce("_src", "_pk")) \
        .drop("_miss", "_salt")
    status = (F.when(F.col("_pk").isNull(), F.lit("no_package"))
              .when(F.col("_src").isNull(), F.lit("no_source")).otherwise(F.lit("ok")))
    msg = (F.when(F.col("_pk").isNull(), F.format_string(rules.MSG_PKG_NOT_FOUND, F.col("_dir")))
           .when(F.col("_src").isNull(),
                 F.format_string(rules.MSG_SRC_NOT_FOUND, F.col("_name"), F.col("_dir"))))
    return j.withColumn("status", status).withColumn("msg", msg).drop("_pk", "_src")


def url_parts(url: Column) -> Column:
    """Host plus path segments of a URL, without scheme, query and fragment."""
    no_scheme = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    no_query = F.regexp_extract(no_scheme, "^([^?#]*)", 1)
    return F.filter(F.split(no_query, "/"), lambda s: s != "")


def dir_tree(paths: DataFrame, parts: str = "parts", with_leaf: bool = False) -> DataFrame:
    """Distinct directories (proper prefixes of each path) with their
    parent, own name and depth: an adjacency list of the tree."""
    n = F.size(parts) - (0 if with_leaf else 1)
    pref = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda k: F.slice(F.col(parts), 1, k))
    ex = paths.filter(n >= 1).select(F.explode(pref).alias("p"))
    d = ex.select(F.array_join("p", "/").alias("dir"),
                  F.when(F.size("p") > 1, F.array_join(F.slice("p", 1, F.size("p") - 1), "/"))
                  .alias("parent"),
                  F.element_at("p", -1).alias("name"), F.size("p").alias("depth"))
    return d.distinct()
