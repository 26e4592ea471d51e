"""The entry file as a driver loads it: by path, from another folder."""

import subprocess
import sys
from pathlib import Path

import pytest

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_file", {str(ENTRY)!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert set(module.oracle_sql()) <= set(module.queries())
print("rows", module.entry(spark).count(), module.queries()["tab_separated"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_entry_from_another_folder(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip() == "rows 400 200", done.stderr[-2000:]
