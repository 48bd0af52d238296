"""The package works for workers that start elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_workers_in_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from assay.sources.datasets import from_csv_text
print("ROWS", from_csv_text(spark, "input,output\\n1,2").size(), from_csv_text(spark, "input,output\\n1,2").get(0).inputs)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path, env=env)
    assert "ROWS 1 {'input': '1'}" in run.stdout, run.stderr[-2000:]
