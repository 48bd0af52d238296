"""Counts of runs kept up by the stream: a delta of few rows a micro-batch, folded into snapshots.

A delta is written under its batch's number, so a batch that is tried again replaces its own. A snapshot holds the sums of all
deltas up to a number; readers take the last one that is whole, and the deltas after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, numbered

SCHEMA = "run_id string, total long, passed long, first_batch long, last_batch long"
FOLD = 32  # deltas that readers add up at most, about


def item_passed() -> Column:
    """An item passes if it has evaluations and none failed; where only its own flag was reported, that counts."""
    return F.when(F.col("evals").isNotNull(), (F.size("evals") > 0) & F.forall("evals", lambda e: e["success"])).otherwise(F.col("success"))


def delta(items: DataFrame, number: int) -> DataFrame:
    """The counts that new items add to their runs."""
    counts = items.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(item_passed()).alias("passed"))
    return counts.select("*", F.lit(number).cast("long").alias("first_batch"), F.lit(number).cast("long").alias("last_batch"))


class Rollup:
    """The rollup in a folder of its own: ``batch=N`` and ``snapshot=N`` tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, items: DataFrame, number: int) -> None:
        """Write the delta of a batch's new items; from time to time fold deltas."""
        delta(items, number).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if len(self._parts(None)) > FOLD:
            self.fold(number)

    def read(self, before: int | None = None, key: str = "string") -> DataFrame:
        """(run_id, total, passed, first_batch, last_batch) of each run with items; of batches ``before`` a number only, if it is given. ``key``: the type of run_id, cast before it is grouped by, so that a join takes the groups as they lie."""
        parts = self._parts(before)
        if not parts:
            return self.spark.createDataFrame([], SCHEMA).withColumn("run_id", F.col("run_id").cast(key))
        rows = self.spark.read.schema(SCHEMA).parquet(*parts).withColumn("run_id", F.col("run_id").cast(key))
        return rows.groupBy("run_id").agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"))

    def fold(self, upto: int) -> None:
        """Make a snapshot of all batches up to one. The snapshot before it and the deltas that it has replaced go; those that readers of the last may hold stay until the next fold."""
        last = self._snapshot(upto)
        if last == upto:
            return
        self.read(upto + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot={upto}")
        for kind, numbers in (("snapshot", numbered(self.spark, self.path, "snapshot")), ("batch", numbered(self.spark, self.path, "batch"))):
            for n in numbers:
                if last is not None and n < last or kind == "batch" and n == last:
                    delete(self.spark, f"{self.path}/{kind}={n}")

    def _snapshot(self, before: int | None) -> int | None:
        return max(numbered(self.spark, self.path, "snapshot", high=None if before is None else before - 1), default=None)

    def _parts(self, before: int | None) -> list[str]:
        last = self._snapshot(before)
        deltas = numbered(self.spark, self.path, "batch", None if last is None else last + 1, None if before is None else before - 1)
        return ([] if last is None else [f"{self.path}/snapshot={last}"]) + [f"{self.path}/batch={n}" for n in deltas]
