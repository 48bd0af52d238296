"""Append-only tables of events that several writers share, and the tracking tables kept so.

An append is a folder of its own, so writers do not meet; it counts once it is written to its end. The state is an aggregate that the same
event may enter twice without harm (the last status, the first creation), so a snapshot may overlap the events that it was made from. A
snapshot is committed by making a file that nobody made before: of two writers who fold at once one wins, and the other's work is thrown away. Events go
only after a later commit than the one that holds them, so a reader who has just listed them still finds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import children, create, delete, read_text, written
from . import tracking


class Log:
    """Events in ``path``; ``state`` turns a frame of events into one of the same columns that stands for them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, state: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self._state = spark, path.rstrip("/"), schema, state

    def append(self, rows: DataFrame) -> str:
        """Write events, whatever others do meanwhile; returns their folder's name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/events/{name}")
        return name

    def state(self) -> DataFrame:
        """What the events so far amount to."""
        return self._state(self._read(self._snapshot()[1], self._events()))

    def fold(self) -> bool:
        """Make a snapshot of all events so far; False if another writer was quicker, which loses nothing."""
        number, base = self._snapshot()
        events, name = self._events(), uuid.uuid4().hex
        target = f"{self.path}/snapshots/{name}"
        self._state(self._read(base, events)).write.parquet(f"{target}/state")
        self.spark.createDataFrame([(e,) for e in events], "event string").coalesce(1).write.parquet(f"{target}/folded")
        if not create(self.spark, f"{self.path}/commits/{number + 1:012d}", name):
            delete(self.spark, target)
            return False
        if base is not None:  # what the commit before this one has folded, and its own base
            for r in self.spark.read.schema("event string").parquet(f"{self.path}/snapshots/{base}/folded").collect():
                delete(self.spark, f"{self.path}/events/{r.event}")
            for old in children(self.spark, f"{self.path}/commits")[:-2]:
                delete(self.spark, f"{self.path}/snapshots/{read_text(self.spark, f'{self.path}/commits/{old}')}")
                delete(self.spark, f"{self.path}/commits/{old}")
        return True

    def _snapshot(self) -> tuple[int, str | None]:
        """Number and name of the last committed snapshot."""
        commits = children(self.spark, f"{self.path}/commits")
        return (int(commits[-1]), read_text(self.spark, f"{self.path}/commits/{commits[-1]}")) if commits else (0, None)

    def _events(self) -> list[str]:
        return [e for e in children(self.spark, f"{self.path}/events") if written(self.spark, f"{self.path}/events/{e}")]

    def _read(self, snapshot: str | None, events: list[str]) -> DataFrame:
        parts = [f"{self.path}/events/{e}" for e in events] + ([f"{self.path}/snapshots/{snapshot}/state"] if snapshot else [])
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)


RUN_EVENT = "run_id string, experiment_id string, config string, started_at timestamp, status string, at timestamp, event string"
NAMED = "{0}_id string, {1}name string, created_at timestamp"


def _last(events: DataFrame) -> DataFrame:
    """A run's last status, by time and then by the event's id; its experiment, configuration and start are those of its creation."""
    when = F.struct("at", "event")
    last = events.groupBy("run_id").agg(F.max("experiment_id").alias("experiment_id"), F.max("config").alias("config"), F.min("started_at").alias("started_at"), F.max_by(F.struct("status", "at", "event"), when).alias("l"))
    return last.select("run_id", "experiment_id", "config", "started_at", "l.status", "l.at", "l.event")


def _first(key: str, *more: str):
    return lambda events: events.groupBy(key, *more, "name").agg(F.min("created_at").alias("created_at"))


class Tracker:
    """Projects, experiments and runs that several writers create and update, each change one event."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._projects = Log(spark, f"{path}/projects", NAMED.format("project", ""), _first("project_id"))
        self._experiments = Log(spark, f"{path}/experiments", NAMED.format("experiment", "project_id string, "), _first("experiment_id", "project_id"))
        self._runs = Log(spark, f"{path}/runs", RUN_EVENT, _last)

    def projects(self) -> DataFrame:
        return self._projects.state()

    def experiments(self) -> DataFrame:
        return self._experiments.state()

    def runs(self) -> DataFrame:
        """Runs as the tracking queries read them."""
        ended = F.when(F.col("status") != "RUNNING", F.col("at"))
        return self._runs.state().where("experiment_id is not null").select("run_id", "experiment_id", "status", "config", "started_at", ended.alias("completed_at"))

    def project(self, names: DataFrame) -> None:
        """Give each name a project, if it has none; two writers who do so at once make one, as the id is that of the name."""
        self._projects.append(tracking.new_projects(self.projects(), names).select("project_id", "name", "created_at"))

    def experiment(self, wanted: DataFrame) -> None:
        """Give each (project_id, name) an experiment, if it has none."""
        self._experiments.append(tracking.new_experiments(self.experiments(), wanted).select("experiment_id", "project_id", "name", "created_at"))

    def begin(self, runs: DataFrame) -> None:
        """Create runs from rows of run_id and experiment_id, with config and started_at if these are there."""
        given = lambda c, other: F.col(c) if c in runs.columns else other
        began = given("started_at", F.current_timestamp())
        self._runs.append(runs.select(F.col("run_id").cast("string").alias("run_id"), F.col("experiment_id").cast("string").alias("experiment_id"), given("config", F.lit(None)).cast("string").alias("config"), began.alias("started_at"), F.lit("RUNNING").alias("status"), began.alias("at"), F.uuid().alias("event")))

    def set_status(self, changes: DataFrame) -> None:
        """Append changes: rows of run_id and status, with a time ``at`` if it is not now. No other run is read or written."""
        at = F.col("at") if "at" in changes.columns else F.current_timestamp()
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        self._runs.append(changes.select(F.col("run_id").cast("string").alias("run_id"), none("experiment_id", "string"), none("config", "string"), none("started_at", "timestamp"), "status", at.alias("at"), F.uuid().alias("event")))

    def update(self, run_id: str, status: str) -> None:
        """One run's new status: one row."""
        self.set_status(self.spark.createDataFrame([(run_id, status)], "run_id string, status string"))

    def fold(self) -> bool:
        return all([log.fold() for log in (self._projects, self._experiments, self._runs)])
