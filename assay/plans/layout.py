"""Items and evaluations laid out by run: bucketed tables, and pages that begin where the last one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .tracking import Store

SALTS = 8  # files that a run's rows are dealt to, so that a large run is no single task's to write


def write_by_run(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a table of the catalog, bucketed by run_id, each file sorted by run, time of creation and id; returns it as read.

    A query for one run reads one bucket, and of its files the row groups of that run. Tables with the same number of buckets are joined and grouped by
    run_id without a shuffle; where a few runs hold most rows set ``spark.sql.sources.bucketing.enabled`` to false for such queries, so that they are split.
    """
    order = [c for c in ("run_id", "created_at", "item_id", "eval_id") if c in df.columns]
    salt = F.pmod(F.xxhash64(*(c for c in ("item_id",) if c in df.columns)), F.lit(SALTS)) if "item_id" in df.columns else F.lit(0)
    writer = df.repartition(buckets * (SALTS if "item_id" in df.columns else 1), "run_id", salt).write.format("parquet").mode("overwrite").bucketBy(buckets, "run_id").sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"drop table if exists {name}")


def page_after(s: Store, run_id, after: Row | tuple | None = None, size: int = 50) -> tuple[DataFrame, Row | None]:
    """The next ``size`` items of a run in order of creation, each with its evaluations, and the key to go on from; None at the end.

    ``after`` is the key (created_at, item_id) that the page before gave. Rows before it are not read, so a late page costs what the first does.
    The page itself, of ``size`` rows at most, goes through the driver; evaluations are asked for by its ids.
    """
    mine = s.items.where(F.col("run_id") == F.lit(run_id))
    if after is not None:
        at, last = (F.lit(x) for x in after)
        mine = mine.where((F.col("created_at") >= at) & ((F.col("created_at") > at) | (F.col("item_id") > last)))
    rows = mine.orderBy("created_at", "item_id").limit(size + 1).collect()
    page, more = rows[:size], len(rows) > size
    items = s.items.sparkSession.createDataFrame(page, s.items.schema)
    evals = s.evals.where((F.col("run_id") == F.lit(run_id)) & F.col("item_id").isin([r.item_id for r in page]))
    fields = [c for c in ("eval_id", "evaluator", "score", "threshold", "success", "reason") if c in s.evals.columns]
    evals = evals.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evaluations"))
    empty = F.array().cast(evals.schema["evaluations"].dataType)
    out = items.join(evals, "item_id", "left").withColumn("evaluations", F.coalesce("evaluations", empty)).orderBy("created_at", "item_id")
    return out, Row(created_at=page[-1].created_at, item_id=page[-1].item_id) if more else None
