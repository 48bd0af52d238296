"""Experiments: a dataset, a task, evaluators and a number of runs, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import results
from ..operators.evaluators import evaluated
from ..shared import Scratch
from ..sources.datasets import Dataset


@dataclass
class Outcome:
    """Items and evaluations of all runs, and their aggregates."""

    name: str
    items: DataFrame
    evals: DataFrame
    runs: int
    description: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    scratch: Scratch | None = None

    def close(self) -> None:
        """Delete the tables of items and evaluations now, if the experiment made them; by itself that happens when the session ends."""
        if self.scratch is not None:
            self.scratch.close()
            self.scratch = None

    def __enter__(self) -> Outcome:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def item_results(self) -> DataFrame:
        return results.item_results(self.items, self.evals, ["run_index", "item_idx"])

    def run_summaries(self) -> DataFrame:
        return results.run_summary(self.item_results(), ["run_index"])

    def summary(self):
        """One row: total, passed, failed, pass_rate, runs; zeros for an empty dataset."""
        return results.experiment_summary(self.run_summaries(), []).withColumn("runs", F.lit(self.runs).cast("long")).first()

    def averages(self) -> DataFrame:
        """average_score, std_dev and pooled pass_rate of each evaluator."""
        runs = self.items.sparkSession.range(self.runs).select(F.col("id").cast("int").alias("run_index"))
        means = results.experiment_averages(results.run_averages(self.evals, runs, ["run_index"]), [])
        return means.join(results.evaluator_pass_rates(self.evals, []), "evaluator").orderBy("evaluator")


class Experiment:
    """``task`` turns the dataset's frame into one with a column actual_output (and any others that evaluators read).

    Runs are rows, not loops: the task sees a column run_index, and Spark spreads all runs' items over
    ``parallelism`` partitions. Evaluators are result Columns or judge-based stages. ``save`` (name, frame) -> frame writes
    items and evaluations, so that a judge or task that answers differently each time is asked once; by default as tables in the shared folder, which go
    when the session ends.
    """

    def __init__(self, dataset: Dataset, task: Callable[[DataFrame], DataFrame], evaluators: list, name: str = "unnamed", runs: int = 1, parallelism: int | None = None, reporter=None, save: Callable[[str, DataFrame], DataFrame] | None = None, description: str = "", metadata: dict[str, str] | None = None):
        if dataset is None or task is None:
            raise ValueError("an experiment needs a dataset and a task")
        if runs < 1 or (parallelism is not None and parallelism < 1):
            raise ValueError("runs and parallelism must be at least 1")
        self.dataset, self.task, self.evaluators, self.name, self.runs, self.parallelism = dataset, task, evaluators, name, runs, parallelism
        self.reporter, self.description, self.metadata = reporter, description, metadata or {}
        self.save = save

    def run(self) -> Outcome:
        """Evaluate all runs; a reporter is told SUCCESS or FAILED whatever happens."""
        handle = self.reporter.start_run(self.name, self.metadata) if self.reporter else None
        status = "FAILED"
        try:
            spark = self.dataset.frame.sparkSession
            cases = self.dataset.frame.withColumnRenamed("example_idx", "item_idx").withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(self.runs - 1))))
            cases = cases.withColumn("input", F.try_element_at("inputs", F.lit("input"))).withColumn("expected_output", F.try_element_at("expected_outputs", F.lit("output")))
            scratch = Scratch(spark, "experiment") if self.save is None else None
            save = self.save or (lambda name, df: scratch.save(df, name))
            items = save("items", self.task(cases.repartition(self.parallelism) if self.parallelism else cases))
            evals = evaluated(items, self.evaluators) if self.evaluators else None
            names = ["run_index", "item_idx", "evaluator_idx", "evaluator", "score", "threshold", "success", "reason", F.col("result_metadata").alias("metadata")]
            empty = "run_index int, item_idx long, evaluator_idx int, evaluator string, score double, threshold double, success boolean, reason string, metadata string"
            evals = save("evals", evals.select(*names)) if evals is not None else spark.createDataFrame([], empty)
            out = Outcome(self.name, items, evals, self.runs, self.description, self.metadata, scratch)
            if self.reporter:
                self.reporter.report(handle, out)
            status = "SUCCESS"
            return out
        finally:
            if self.reporter:
                self.reporter.complete_run(handle, status)
                self.reporter.flush()


def assert_eval(case: DataFrame, evaluators: list) -> None:
    """Raise AssertionError for the first evaluator, in order, that any case fails."""
    failed = evaluated(case, evaluators).where(~F.col("success")).orderBy("evaluator_idx").select("evaluator", "score", "threshold", "reason").first()
    if failed:
        bar = "" if failed.threshold is None else f" (threshold {failed.threshold:.2f})"
        raise AssertionError(f"{failed.evaluator}: score {failed.score:.2f}{bar}: {failed.reason}")


def quality_gate(outcome: Outcome, pass_rate: float | None = None, scores: dict[str, float] | None = None) -> None:
    """Raise AssertionError if the pass rate or an evaluator's mean is too low."""
    if pass_rate is not None and (got := outcome.summary().pass_rate) < pass_rate:
        raise AssertionError(f"pass rate {got} is below {pass_rate}")
    means = {r.evaluator: r.average_score for r in outcome.averages().collect()} if scores else {}
    for name, least in (scores or {}).items():
        if means.get(name, 0.0) < least:
            raise AssertionError(f"{name}: mean {means.get(name, 0.0)} is below {least}")
