"""Session helpers: building a session and resolving the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: HotSpot compiles no method of more bytecode than this; Spark's default leaves longer ones
#: of whole-stage code to the bytecode interpreter, several times slower than plain operators.
METHOD_LIMIT = "8000"


def compiled_methods(spark: SparkSession) -> None:
    """Let plans whose generated method is too long for the JVM's compiler run without it (the
    value that Spark's own description of the setting advises on HotSpot)."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > int(METHOD_LIMIT):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for the corpus jobs (AQE on, UI off, UTC, ANSI as default)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there.  Only a local-mode session
    without one (tests, the bench) gets a fresh scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect: the server names the folder
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder for checkpoints")
    scratch = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back: packed by column, where a
    checkpoint holds whole rows as they lie in memory, and a reader takes only its columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (also to executors that
    join later).  Spark's own file distribution carries it; the zip on the driver is only what
    is handed to it."""
    sc = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(home)
    if any(f.endswith(f"/{name}.zip") for f in sc.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-package-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(home)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, home)))
    sc.addPyFile(path)
