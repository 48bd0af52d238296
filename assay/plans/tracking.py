"""Tracking store: projects, experiments, runs, items and evaluations, and the queries over them.

Tables are DataFrames; each function is one plan, with a number of jobs that does not depend on how many runs
there are. Writes return the rows to append, or the table as it is afterwards.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scratch, dealt

_S, _D, _B, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


PROJECTS = _schema(("project_id", _S, False), ("name", _S, False), ("created_at", _TS, False))
EXPERIMENTS = _schema(("experiment_id", _S, False), ("project_id", _S, False), ("name", _S, False), ("created_at", _TS, False))
RUNS = _schema(("run_id", _S, False), ("experiment_id", _S, False), ("status", _S, False), ("config", _S, True), ("started_at", _TS, False), ("completed_at", _TS, True))
ITEMS = _schema(("item_id", _S, False), ("run_id", _S, False), ("input", _S, False), ("expected_output", _S, True), ("actual_output", _S, False), ("metadata", _S, True), ("created_at", _TS, False))
EVALS = _schema(("eval_id", _S, False), ("run_id", _S, False), ("item_id", _S, False), ("evaluator", _S, False), ("score", _D, False), ("threshold", _D, True), ("success", _B, False), ("reason", _S, True))
COMPLETED = ("SUCCESS", "FAILED")


class NotFound(ValueError):
    """No such project, experiment or run."""


@dataclass
class Store:
    """The five tables, and if it is kept the rollup (run_id, total, passed) of items and evaluations, which is then read in their place."""

    projects: DataFrame
    experiments: DataFrame
    runs: DataFrame
    items: DataFrame
    evals: DataFrame
    rollup: DataFrame | None = None

    def counts(self, runs: DataFrame, every: bool = False) -> DataFrame:
        return run_counts(runs, self.items, self.evals, every) if self.rollup is None else with_counts(runs, self.rollup, self.rollup)


def passed_items(items: DataFrame, evals: DataFrame) -> DataFrame:
    """Items with an evaluation and none that failed: those without any do not pass here."""
    judged = evals.groupBy("item_id").agg(F.bool_and("success").alias("_all"))
    return items.join(judged.where("_all"), "item_id", "left_semi")


def run_counts(runs: DataFrame, items: DataFrame, evals: DataFrame, every: bool = False) -> DataFrame:
    """total and passed items of each run; zeros for a run without items.

    Items and evaluations are cut to the wanted runs before they are aggregated, unless ``runs`` are ``every`` run there is.
    """
    wanted = runs.select("run_id")
    cut = lambda df: df if every else df.join(wanted, "run_id", "left_semi")
    total = cut(items.select("run_id")).groupBy("run_id").agg(F.count("*").alias("total"))
    judged = cut(evals.select("run_id", "item_id", "success")).groupBy("run_id", "item_id").agg(F.bool_and("success").alias("_all"))
    passed = judged.where("_all").groupBy("run_id").agg(F.count("*").alias("passed"))
    return with_counts(runs, total, passed)


def with_counts(runs: DataFrame, total: DataFrame, passed: DataFrame) -> DataFrame:
    """Runs with columns total and passed; zeros where a table lacks a run."""
    zero = F.lit(0).cast("long")
    both = total.select("run_id", "total", "passed") if total is passed else total.join(passed, "run_id", "left")
    return runs.join(both, "run_id", "left").withColumn("total", F.coalesce("total", zero)).withColumn("passed", F.coalesce("passed", zero))


def _chosen(runs: DataFrame) -> DataFrame:
    """Ranked runs, written once: they cut items, cut evaluations and are joined to the counts."""
    return Scratch(runs.sparkSession, "runs").save(runs, "chosen")


def _rate() -> Column:
    return F.try_divide(F.col("passed").cast("double"), F.col("total"))


def list_projects(s: Store) -> DataFrame:
    """Projects with their number of experiments, the newest first."""
    counts = s.experiments.groupBy("project_id").agg(F.count("*").alias("_n"))
    out = s.projects.join(counts, "project_id", "left").select("project_id", "name", "created_at", F.coalesce("_n", F.lit(0).cast("long")).alias("experiment_count"))
    return out.orderBy(F.desc("created_at"), "project_id")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of each experiment that started last."""
    last = Window.partitionBy("experiment_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def list_experiments(s: Store, project_id: str | None = None) -> DataFrame:
    """Experiments with their latest run, whose rate is null while it runs or has no items; all projects' without ``project_id``."""
    experiments = s.experiments if project_id is None else s.experiments.where(F.col("project_id") == F.lit(project_id))
    runs = s.runs if project_id is None else s.runs.join(experiments, "experiment_id", "left_semi")
    latest = s.counts(_chosen(latest_runs(runs)))
    rate = F.when(F.col("status") != "RUNNING", _rate())
    latest = latest.select("experiment_id", "run_id", "status", "started_at", rate.alias("pass_rate"))
    return experiments.join(latest, "experiment_id", "left").orderBy(F.desc("created_at"), "experiment_id")


def list_runs(s: Store, experiment_id: str | None = None) -> DataFrame:
    """Runs with counts, the newest first; the rate is null without items."""
    runs = s.runs if experiment_id is None else s.runs.where(F.col("experiment_id") == F.lit(experiment_id))
    return s.counts(runs, every=experiment_id is None).withColumn("pass_rate", _rate()).orderBy(F.desc("started_at"), "run_id")


def trends(s: Store, limit: int = 20, experiment_id: str | None = None) -> DataFrame:
    """The last ``limit`` completed runs of each experiment in order of time; the rate is 0 without items."""
    runs = s.runs if experiment_id is None else s.runs.where(F.col("experiment_id") == F.lit(experiment_id))
    last = Window.partitionBy("experiment_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    runs = dealt(runs.where(F.col("status").isin(*COMPLETED)), "experiment_id").withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= limit).drop("_nth")
    out = s.counts(_chosen(runs)).withColumn("pass_rate", F.coalesce(_rate(), F.lit(0.0)))
    return out.orderBy("experiment_id", "started_at", "run_id")


def shown(total: int, page: int = 0, size: int = 20) -> dict[str, int]:
    """What a list's pager tells: first and last row shown (from 1; 0 and 0 for none), all rows, number of pages."""
    return {"first": min(page * size + 1, total), "last": min((page + 1) * size, total), "total": total, "pages": -(-total // size)}


def table_order(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows in the order of a shown column: by number where it is one (a % sign is left out), else by text."""
    text = F.col(column).cast("string")
    keys = (F.replace(text, F.lit("%"), F.lit("")).try_cast("double"), text)
    return df.orderBy(*(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys))


def chart_points(trend: DataFrame) -> DataFrame:
    """Points for a chart: percent, where there is a rate; an experiment needs two of them."""
    n = F.count("*").over(Window.partitionBy("experiment_id"))
    points = trend.where("pass_rate is not null").withColumn("_n", n).where("_n >= 2").drop("_n")
    return points.withColumn("percent", F.floor(F.col("pass_rate") * 100 + 0.5))


def run_page(s: Store, run_id: str, page: int = 0, size: int = 50) -> DataFrame:
    """One page of a run's items in order of creation, each with its evaluations."""
    items = s.items.where(F.col("run_id") == F.lit(run_id)).orderBy("created_at", "item_id").offset(page * size).limit(size)
    evals = s.evals.where(F.col("run_id") == F.lit(run_id)).join(items.select("item_id"), "item_id", "left_semi")
    evals = evals.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("eval_id", "evaluator", "score", "threshold", "success", "reason"))).alias("evaluations"))
    empty = F.array().cast(evals.schema["evaluations"].dataType)
    return items.join(evals, "item_id", "left").withColumn("evaluations", F.coalesce("evaluations", empty)).orderBy("created_at", "item_id")


def run_details(s: Store, run_id: str, page: int = 0, size: int = 50) -> dict:
    """A run's head (with the names of its experiment and project) as a row, and a page of items."""
    runs = s.runs.where(F.col("run_id") == F.lit(run_id))
    mine = F.col("run_id") == F.lit(run_id)
    head = Store(s.projects, s.experiments, s.runs, s.items.where(mine), s.evals.where(mine), s.rollup).counts(runs, every=True).withColumn("pass_rate", _rate())
    head = head.join(s.experiments.select("experiment_id", "project_id", F.col("name").alias("experiment")), "experiment_id").join(s.projects.select("project_id", F.col("name").alias("project")), "project_id").first()
    if head is None:
        raise NotFound(f"run not found: {run_id}")
    return {"run": head, "items": run_page(s, run_id, page, size), "pages": -(-head.total // size)}


def find(df: DataFrame, **key) -> DataFrame:
    """Rows with the given values; none raises."""
    for k, v in key.items():
        df = df.where(F.col(k) == F.lit(v))
    if df.isEmpty():
        raise NotFound(f"not found: {key}")
    return df


def _id(*columns: str) -> Column:
    """An id that depends on the natural key alone, so that writing twice writes the same."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


def new_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    """Rows to append so that each name has a project."""
    return names.select("name").distinct().join(projects, "name", "left_anti").select(_id("name").alias("project_id"), "name", F.current_timestamp().alias("created_at"))


def new_experiments(experiments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to append so that each (project_id, name) has an experiment."""
    key = ["project_id", "name"]
    missing = wanted.select(key).distinct().join(experiments, key, "left_anti")
    return missing.select(_id(*key).alias("experiment_id"), *key, F.current_timestamp().alias("created_at"))


def new_run(experiments: DataFrame, config: str | None = None) -> DataFrame:
    """A row to append: a run that has just begun, for each experiment given."""
    return experiments.select(F.uuid().alias("run_id"), "experiment_id", F.lit("RUNNING").alias("status"), F.lit(config).cast("string").alias("config"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def set_status(runs: DataFrame, run_id: str, status: str) -> DataFrame:
    """The runs with a new status; any but RUNNING completes the run now."""
    mine = F.col("run_id") == F.lit(run_id)
    done = F.current_timestamp() if status != "RUNNING" else F.lit(None).cast("timestamp")
    return runs.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "completed_at": F.when(mine, done).otherwise(F.col("completed_at"))})


def added_items(payload: DataFrame, runs: DataFrame, call: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Item and evaluation rows to append, from rows (run_id, items) of reported items.

    Each item has maps inputs, expectedOutputs and actualOutputs and a list evalResults; its own success flag is left aside and the
    inputs are stored once more as metadata. Items of unknown runs are left out.

    Every item of every request is stored, equal ones too. A column ``request`` tells a run's requests apart, so that one that is sent again
    gives the same ids; without it, equal requests are numbered and ids hold for this call alone: give the same ``call`` to repeat it.
    """
    known = payload.join(runs.select("run_id"), "run_id", "left_semi")
    if "request" in payload.columns:
        known = known.withColumn("_call", F.lit("")).withColumn("_request", F.col("request").cast("string"))
    else:
        same = F.md5(F.to_json("items").cast("binary"))
        nth = F.row_number().over(Window.partitionBy("run_id", "_same").orderBy(F.lit(0)))
        known = known.withColumn("_call", F.lit(call or uuid.uuid4().hex)).withColumn("_same", same).withColumn("_request", F.concat_ws("-", "_same", nth.cast("string")))
    flat = known.select("run_id", "_call", "_request", F.posexplode("items").alias("at", "item"))
    flat = flat.select("run_id", _id("_call", "run_id", "_request", "at").alias("item_id"), F.struct(*(f"item.{c}" for c in ("inputs", "expectedOutputs", "actualOutputs", "evalResults"))).alias("item"))
    flat = dealt(Scratch(payload.sparkSession, "added").save(flat, "flat"), "run_id")  # written once: items and evaluations are both read from it
    text = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    items = flat.select(
        "item_id", "run_id", text(F.col("item.inputs")).alias("input"), text(F.col("item.expectedOutputs")).alias("expected_output"),
        text(F.col("item.actualOutputs")).alias("actual_output"), text(F.col("item.inputs")).alias("metadata"), F.current_timestamp().alias("created_at"),
    )
    evals = flat.select("run_id", "item_id", F.posexplode("item.evalResults").alias("nth", "e"))
    evals = evals.select(_id("item_id", "nth").alias("eval_id"), "run_id", "item_id", F.col("e.name").alias("evaluator"), F.col("e.score").alias("score"), F.col("e.threshold").alias("threshold"), F.col("e.success").alias("success"), F.col("e.reason").alias("reason"))
    return items, evals


def reported(items: DataFrame) -> DataFrame:
    """Items as a reporter sends them: a null reason is empty, a null threshold left out, example metadata dropped."""
    evals = F.transform("evals", lambda e: F.struct(e["name"].alias("name"), e["score"].alias("score"), e["threshold"].alias("threshold"), e["success"].alias("success"), F.coalesce(e["reason"], F.lit("")).alias("reason")))
    return items.select("run_id", F.to_json(F.struct(F.col("inputs"), F.col("expected_outputs").alias("expectedOutputs"), F.col("actual_outputs").alias("actualOutputs"), "success", evals.alias("evalResults"))).alias("body"))


def run_table(s: Store, run_id: str | None, names: list[str]) -> DataFrame:
    """Items against evaluators: score and success of the first evaluation of each name."""
    items = s.items if run_id is None else s.items.where(F.col("run_id") == F.lit(run_id))
    evals = s.evals if run_id is None else s.evals.where(F.col("run_id") == F.lit(run_id))
    at = lambda name, c: F.min_by(c, F.when(F.col("evaluator") == name, F.col("eval_id"))).alias(f"{name}_{c}")
    items = dealt(items.select("item_id", "run_id", "input"), "item_id")
    evals = dealt(evals.select("item_id", "evaluator", "eval_id", "score", "success"), "item_id")
    cells = evals.join(items.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(*(at(name, c) for name in sorted(names) for c in ("score", "success")))
    return items.join(cells, "item_id", "left")


