"""Aggregates from evaluation to item, run and experiment.

Frames are long: ``evals`` has (experiment..., run_index, item_idx, evaluator_idx, evaluator, score, threshold, success, reason)
and ``items`` (experiment..., run_index, item_idx). ``by`` names the columns that tell experiments apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import r6, safe_name
from ..shared import dealt

ZERO = 0.0


def all_passed(success: str = "success") -> Column:
    """True if none failed, and for none at all."""
    return F.coalesce(F.bool_and(success), F.lit(True))


def item_results(items: DataFrame, evals: DataFrame, keys: list[str]) -> DataFrame:
    """Success of each item: an item without evaluations passes."""
    judged = evals.groupBy(*keys).agg(F.bool_and("success").alias("_passed"))
    return items.select(*keys).join(judged, keys, "left").select(*keys, F.coalesce("_passed", F.lit(True)).alias("success"))


def rate(passed: Column, total: Column) -> Column:
    return r6(F.coalesce(F.try_divide(passed.cast("double"), total), F.lit(ZERO)))


def run_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """total, passed, failed and pass rate of each run, from items with their success."""
    out = items.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("success").alias("passed"))
    return out.select(*by, "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), rate(F.col("passed"), F.col("total")).alias("pass_rate"))


def run_averages(evals: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean score of each evaluator in each run: 0 in a run that lacks it, so the grid has no holes.

    ``by`` ends in the run's column; the others tell experiments apart.
    """
    *outer, _ = by
    names = evals.select(*outer, "evaluator").distinct()
    grid = runs.select(*by).distinct().join(names, outer) if outer else runs.select(*by).distinct().crossJoin(names)
    means = evals.groupBy(*by, "evaluator").agg(r6(F.avg("score")).alias("_mean"))
    return grid.join(means, [*by, "evaluator"], "left").select(*by, "evaluator", F.coalesce("_mean", F.lit(ZERO)).alias("average_score"))


def experiment_averages(averages: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the rounded run means and their sample deviation, both rounded."""
    return averages.groupBy(*by, "evaluator").agg(r6(F.avg("average_score")).alias("average_score"), r6(F.coalesce(F.stddev_samp("average_score"), F.lit(ZERO))).alias("std_dev"), F.count("*").alias("runs"))


def experiment_summary(runs: DataFrame, by: list[str], run: str = "run_index") -> DataFrame:
    """Counts and pass rate of each experiment from its run summaries: totals are those of run 0; without runs all are 0."""
    mean = lambda c: r6(F.coalesce(F.avg(c), F.lit(ZERO))).alias(c)
    out = runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(run) == 0, F.col("total"))), F.lit(0)).alias("total"), mean("passed"), mean("pass_rate"), F.count("*").alias("runs"))
    return out.select(*by, "total", "passed", r6(F.col("total") - F.col("passed")).alias("failed"), "pass_rate", "runs")


def evaluator_pass_rates(evals: DataFrame, by: list[str]) -> DataFrame:
    """Share of passed evaluations, all runs together."""
    return evals.groupBy(*by, "evaluator").agg(r6(F.avg(F.col("success").cast("int").cast("double"))).alias("pass_rate"))


def item_across_runs(evals: DataFrame, by: list[str]) -> DataFrame:
    """Each item and evaluator over all runs: mean, deviation, number, scores in run order, first threshold and reason, success in all.

    ``scores`` is a list that grows with the runs; it is not gathered where it is not read. Without a bound on runs take ``item_scores``.
    """
    order = F.struct("run_index", "evaluator_idx")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("run_index", "evaluator_idx", "score"))), lambda x: x["score"])
    return evals.groupBy(*by, "item_idx", "evaluator").agg(
        r6(F.avg("score")).alias("average_score"), r6(F.coalesce(F.stddev_samp("score"), F.lit(ZERO))).alias("std_dev"), F.count("*").alias("n"), scores.alias("scores"),
        F.min_by("threshold", F.when(F.col("threshold").isNotNull(), order)).alias("threshold"),
        F.coalesce(F.min_by("reason", F.when(F.col("reason") != "", order)), F.lit("")).alias("reason"), F.bool_and("success").alias("success"),
    )


def item_scores(evals: DataFrame, by: list[str]) -> DataFrame:
    """The scores of each item and evaluator over all runs, a row each, in run order."""
    keys = [*by, "item_idx", "evaluator", "run_index", "evaluator_idx"]
    return evals.select(*keys, "score").orderBy(*keys)


def item_success_across_runs(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "item_idx").agg(all_passed().alias("success"))


def first_failures(items: DataFrame, by: list[str]) -> DataFrame:
    """The first run in which each item failed."""
    return items.where(~F.col("success")).groupBy(*by, "item_idx").agg(F.min("run_index").alias("run_index"))


def evaluator_names(evals: DataFrame, by: list[str] | None = None) -> DataFrame:
    return evals.select(*(by or []), "evaluator").distinct().orderBy(*(by or []), "evaluator")


def pivoted(evals: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """A row per item with ``<name>_score`` and ``<name>_pass`` for each evaluator; of repeats the last counts; missing ones are null.

    Names that are equal once made safe get a number from the second on.
    """
    return cells(evals, by, names).select(*by, *(F.col(f"{at}_{k}").alias(f"{shown}_{k}") for at, shown in enumerate(distinct_names(names), 1) for k in ("score", "pass")))


def cells(evals: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """As :func:`pivoted`, with columns ``<n>_score`` and ``<n>_pass`` for the n-th name, from 1: no name can clash or break a column's."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col("evaluator"))
    return dealt(evals.select(*by, "evaluator_idx", "score", "success", at.alias("_at")), *by).groupBy(*by).pivot("_at", list(range(1, len(names) + 1))).agg(F.max_by("score", "evaluator_idx").alias("score"), F.max_by("success", "evaluator_idx").alias("pass"))


def distinct_names(names: list[str]) -> list[str]:
    """Safe column names in the same order, each once."""
    out: list[str] = []
    for name in map(safe_name, names):
        n = 1
        while (shown := name if n == 1 else f"{name}_{n}") in out:
            n += 1
        out.append(shown)
    return out


def assert_all(evals: DataFrame, by: list[str]) -> DataFrame:
    """The first failed evaluation of each case, by evaluator order."""
    first = F.min_by(F.struct("evaluator", "score", "threshold", "reason"), "evaluator_idx").alias("_first")
    return evals.where(~F.col("success")).groupBy(*by).agg(first).select(*by, "_first.*")
