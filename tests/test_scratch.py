"""What queries write on their way is gone when the application has ended."""

import os
import subprocess
import sys
from pathlib import Path

RUN = """
import sys
from pyspark.sql import SparkSession
from tickloom.sources.scratch import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("rows", stored(spark.range(5), "five").count())
"""


def test_removed_at_the_end(tmp_path):
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], capture_output=True, text=True, env=env, timeout=120)
    assert "rows 5" in ran.stdout
    assert not list(tmp_path.rglob("*.parquet"))
