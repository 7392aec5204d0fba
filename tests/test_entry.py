"""The entry file from another folder, in a process of its own, without the repository on any path."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_file", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
queries, oracles = entry.queries(), entry.oracle_sql()
from veilwork import catalog
assert not catalog.FAILED, catalog.FAILED
assert len(queries) >= 156 and len(oracles) >= 152
for key in {keys!r}:
    print(key, queries[key](spark, "/root/testdata/sf0.001").count())
"""


def run_elsewhere(folder, keys) -> str:
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    code = CODE.format(path=str(REPO / "__spark_entry__.py"), folder=str(folder), keys=keys)
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_entry_runs_from_any_folder(tmp_path):
    out = run_elsewhere(tmp_path, ["shannon_entropy", "text_features_13", "relabel_by_containment", "scale_unit_variance"])
    assert "relabel_by_containment 200" in out
