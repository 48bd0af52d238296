"""Bucketed tables and seek paging: results, and what the plans read."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from assay.plans import layout, tracking

N = 8


@pytest.fixture(scope="module")
def store(spark):
    """Forty runs; run 7 holds most of the rows, many of them made at the same moment."""
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit("r7")).otherwise(F.concat(F.lit("r"), (F.col("id") % 40).cast("string"))).alias("run_id"), F.format_string("i%05d", (F.col("id") * 7919) % 6000).alias("item_id"), F.timestamp_add("SECOND", (F.col("id") / 5).cast("int"), F.lit(t0)).alias("created_at"))
    items = layout.write_by_run(rows.select("*", F.lit("x").alias("input")), "t_items", N)
    evals = rows.select("run_id", "item_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("evaluator")).withColumns({"eval_id": F.concat("item_id", "evaluator"), "score": F.lit(1.0), "threshold": F.lit(None).cast("double"), "success": F.col("evaluator") == "A", "reason": F.lit(None).cast("string")})
    evals = layout.write_by_run(evals, "t_evals", N)
    runs = layout.write_by_run(spark.range(42).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"), F.lit("e").alias("experiment_id")), "t_runs", N)
    yield tracking.Store(None, None, runs, items, evals)
    layout.drop(spark, "t_items", "t_evals", "t_runs")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_go_on_where_the_last_ended(store):
    want = [r.item_id for r in store.items.where("run_id = 'r7'").orderBy("created_at", "item_id").collect()]
    got, key, pages = [], None, 0
    while pages == 0 or key is not None:
        page, key = layout.page_after(store, "r7", key, size=700)
        rows = page.collect()
        assert all([e.evaluator for e in r.evaluations] == ["A", "B"] for r in rows)
        got, pages = got + [r.item_id for r in rows], pages + 1
    assert got == want and pages == -(-len(want) // 700)
    page, key = layout.page_after(store, "none")
    assert page.collect() == [] and key is None
    assert [r.item_id for r in layout.page_after(store, "r7", size=50)[0].collect()] == [r.item_id for r in tracking.run_page(store, "r7").collect()]


def test_a_page_reads_one_bucket_and_what_comes_after_the_key(spark, store):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only so that the plan names the buckets
    key = layout.page_after(store, "r7", size=3000)[1]
    after = store.items.where((F.col("run_id") == "r7") & (F.col("created_at") >= F.lit(key.created_at)))
    text = plan(after)
    assert f"SelectedBucketsCount: 1 out of {N}" in text and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(created_at", text)
    assert f"SelectedBucketsCount: 1 out of {N}" in plan(store.evals.where(F.col("run_id") == "r7"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_counts_of_runs_do_not_shuffle(store):
    counts = tracking.run_counts(store.runs, store.items, store.evals, every=True)
    assert "hashpartitioning" not in plan(counts)
    got = {r.run_id: (r.total, r.passed) for r in counts.collect()}
    plain = {r.run_id: r.n for r in store.items.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, (v, _) in got.items() if v} == plain and len(got) == 42 and all(p == 0 for _, p in got.values())
