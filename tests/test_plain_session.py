"""Queries as a driver runs them: a session without the package's settings, another working folder, no module path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
queries = entry.queries()
for name in ("element_counts", "spend_admission", "streamed_purchase_lifecycle"):
    print("rows", name, queries[name](spark, {folder!r}).count())
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")
def test_queries_in_a_plain_session(tmp_path):
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(entry=str(entry), folder=FOLDER)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [int(line.split()[2]) > 0 for line in done.stdout.splitlines() if line.startswith("rows ")] == [True] * 3
