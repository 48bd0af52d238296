"""Where intermediate tables go, and that a result outlives the tables it came from."""

import glob
import subprocess
import sys

from assay.llm.graph import components
from assay.llm.scratch import Scratch


def test_result_outlives_its_sources(spark):
    s = Scratch(spark, "t")
    a = s.save(spark.range(10), "a")
    out = s.result(a.where("id > 3"))
    assert out.count() == 6 and s.names == ["result"]
    assert [p.rsplit("/", 1)[1] for p in glob.glob(s.path.removeprefix("file://") + "/*")] == ["result"]


def test_session_without_a_checkpoint_folder():
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from assay.llm.scratch import Scratch
print("ROWS", Scratch(spark, "t").save(spark.range(3), "a").count())
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "ROWS 3" in run.stdout, run.stderr[-2000:]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)] + [(7, 6), (7, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).collect() == []
