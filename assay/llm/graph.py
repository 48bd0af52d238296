"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b); component is the smallest id that can be reached.

    Each round takes the smallest label among neighbours, then the label's own
    label, so that long chains shorten by halves. Labels stay in tables; the
    driver sees one count a round. No edge: an empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.where("a <> b"), f"{name}-edges")
    label = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        near = scratch.save(near, f"{name}-near-{k}")
        step = label.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        step = scratch.save(step, f"{name}-step-{k}")
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        new = step.join(jump, "to").select("id", F.least("to", "further").alias("component"), "was")
        new = scratch.save(new, f"{name}-{k}")
        moved = new.where("component <> was").limit(1).count()
        label = new.select("id", "component")
        if not moved:
            return label
