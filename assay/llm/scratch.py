"""Intermediate tables of the operators, and the size of what goes to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shared import Scratch, shared_dir
from ..shipping import ship

__all__ = ["Scratch", "batches", "shared_dir"]


def batches(spark: SparkSession, rows: int = 1024, megabytes: int = 8) -> None:
    """Keep Arrow batches small, so that a worker's memory does not depend on how long the texts are; send it this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
