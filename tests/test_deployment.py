"""The entry without the training-data folders, and from another folder than the workers know."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
qs, sql = entry.queries(), entry.oracle_sql()
print("SMALL", len(qs), any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in [*qs, *sql]))
print("ROWS", len(entry.entry(spark).collect()), *[qs[n](spark, "/root/testdata/sf0.001").count()
                                                 for n in sys.argv[2:]])
"""


def run(tree, cwd, *names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tree), *names], cwd=cwd, env=env, timeout=300,
                         capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-3000:]
    return {line.split()[0]: line.split()[1:] for line in out.stdout.splitlines() if line[:5] in ("SMALL", "ROWS ")}


def copy(target, *skip):
    shutil.copytree(ROOT, target, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache")
        or os.path.relpath(os.path.join(d, n), ROOT) in skip])


def test_entry_without_training_data_folders(tmp_path):
    copy(tmp_path / "tree", os.path.join("tessera", "llm"), os.path.join("tests", "llm"))
    got = run(tmp_path / "tree", tmp_path, "class_histogram", "span_udtf")
    assert got["SMALL"][1] == "False" and int(got["SMALL"][0]) >= 52
    assert all(int(n) > 0 for n in got["ROWS"])
    copy(tmp_path / "bare", os.path.join("tessera", "llm"), os.path.join("tests", "llm"), "corpus_pipeline.py")
    assert run(tmp_path / "bare", tmp_path)["SMALL"] == got["SMALL"]


def test_workers_get_the_package_from_any_folder(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "tessera", "llm")):
        return
    assert int(run(ROOT, tmp_path, "op2_secrets")["ROWS"][1]) > 0
