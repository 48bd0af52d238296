"""Reporters: item results on their way to a table, in micro-batches.

The stream is Structured Streaming over a folder of reported items. Its sink writes each micro-batch under the batch's number, so that one that is
tried again replaces itself, and only items that no earlier batch stored; then the rollup of its runs' counts, and receipts: how many
items of which report have arrived. A reporter is flushed when the receipts agree with what it reported.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import children, dealt, delete, mark, numbered, repeats
from .delivery import BATCH, Outbox, Receiver
from .rollup import Rollup

EVERY = "500 milliseconds"
FLUSH_S = 30.0
EVAL = "struct<name:string,score:double,threshold:double,success:boolean,reason:string>"
SCHEMA = f"run_id string, item_idx long, input string, actual_output string, success boolean, score double, evals array<{EVAL}>"
RECEIPTS = "report string, n long"


@dataclass
class Settings:
    """Where a reporter sends to: from the session's ``assay.reporter.*``, else from the environment's ``ASSAY_REPORTER_*``."""

    url: str
    project: str
    key: str | None = None
    version: str = "v1"

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        found = {n: spark.conf.get(f"assay.reporter.{n}", None) or os.environ.get(f"ASSAY_REPORTER_{n.upper()}") for n in ("url", "project", "key", "version")}
        for n in ("url", "project"):
            if not found[n]:
                raise ValueError(f"a reporter needs assay.reporter.{n}")
        return Settings(found["url"].rstrip("/"), found["project"], found["key"], found["version"] or "v1")


class Reporter(Protocol):
    def start_run(self, name: str, metadata: dict[str, str]) -> str: ...
    def report(self, handle: str, outcome) -> None: ...
    def complete_run(self, handle: str, status: str) -> None: ...
    def flush(self) -> bool: ...
    def close(self) -> None: ...


class NoOpReporter:
    def start_run(self, name: str, metadata: dict[str, str]) -> str:
        return str(uuid.uuid4())

    def report(self, handle: str, outcome) -> None: ...
    def complete_run(self, handle: str, status: str) -> None: ...
    def close(self) -> None: ...

    def flush(self) -> bool:
        return True


def local_handle() -> str:
    """A handle for a run that no server knows."""
    return f"local-{int(time.time() * 1000)}"


def requests(batch: DataFrame, size: int = BATCH) -> DataFrame:
    """(run_id, request, n, items): a run's items in requests of at most ``size``, in order of item_idx."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("item_idx")) - 1
    part = batch.withColumn("request", F.floor(nth / size))
    item = F.struct("item_idx", *(c for c in ("input", "actual_output", "success", "score", "evals") if c in batch.columns))
    return part.groupBy("run_id", "request").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("item_idx").alias("at"), item.alias("item")))).alias("items")).withColumn("items", F.transform("items", lambda x: x["item"]))


def bodies(batch: DataFrame, size: int = BATCH) -> DataFrame:
    """(run_id, key, n, body): the requests of a whole batch as they are sent."""
    texts = requests(batch, size).select("run_id", "n", F.to_json(F.struct("items")).alias("body"))
    return texts.select("run_id", F.substring(F.sha2(F.concat_ws("\n", "run_id", "body"), 256), 1, 32).alias("key"), "n", "body")


def hand_over(rows: DataFrame, folder: str) -> None:
    """Append reported items to the folder that the stream reads: JSON lines in gzip, about a tenth of the bytes."""
    rows.write.mode("append").option("compression", "gzip").json(folder)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = False, files_per_batch: int | None = None, receiver: Receiver | None = None):
    """Begin to store reported items (JSON lines in ``source``) in ``target``; returns the streaming query.

    Beside ``target`` stand ``target``-rollup (see :class:`Rollup`) and ``target``-receipts. With a ``receiver`` each micro-batch's items go there too, in requests
    of ten cut by the batch; :func:`start_sending` gathers them over batches.
    """
    rollup = Rollup(spark, f"{target}-rollup")

    def store(batch: DataFrame, number: int) -> None:
        # parsed once, to a table without the mark that it counts, and not persisted: a batch of any size holds no memory
        whole, place = f"{target}/whole={number}", f"{target}/batch={number}"
        batch.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(whole)
        batch = spark.read.schema(f"{SCHEMA}, report string").parquet(whole)
        new, repeated = batch.drop("report"), repeats(batch, "run_id", "item_idx")
        if repeated:
            new = dealt(new, "run_id", "item_idx", each=1 << 20, large=True).dropDuplicates(["run_id", "item_idx"])
        parts = tables(spark, target, high=number - 1)
        if len(parts) > 1:
            # a run's items lie in the batches from its first to its last
            span = rollup.read(before=number).join(batch.select("run_id").distinct(), "run_id", "left_semi").agg(F.min("first_batch"), F.max("last_batch")).first()
            parts = tables(spark, target, *span) if span[0] is not None else []
        if parts:
            new = new.join(spark.read.schema(SCHEMA).parquet(*parts).select("run_id", "item_idx"), ["run_id", "item_idx"], "left_anti")
        if repeated or parts:
            new.write.mode("overwrite").parquet(place)
        else:
            delete(spark, place)
            mark(spark, whole)
            place = whole
        items = spark.read.schema(SCHEMA).parquet(place)
        rollup.add(items, number)
        batch.groupBy("report").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}-receipts/batch={number}")
        if receiver:
            Outbox(spark, f"{target}-requests", receiver).deliver(bodies(items), number)
        if place != whole:
            delete(spark, whole)

    writer = reported_items(spark, source, files_per_batch).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def tables(spark: SparkSession, target: str, low: int | None = None, high: int | None = None) -> list[str]:
    """Where the items of batches, from ``low`` to ``high``, are stored: ``whole=N`` as they came, ``batch=N`` without those that had come before."""
    return [f"{target}/{kind}={k}" for kind in ("whole", "batch") for k in numbered(spark, target, kind, low, high)]


def reported_items(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of items, each with the report that it came by."""
    reader = spark.readStream.schema(f"{SCHEMA}, report string")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)


def start_sending(spark: SparkSession, source: str, path: str, checkpoint: str, receiver: Receiver, files_per_batch: int | None = None):
    """Begin to send reported items in requests of ten, or of fewer half a second after the first; what became of them is in ``Outbox(spark, path, ...).ledger()``."""
    return Outbox(spark, path, receiver).start(reported_items(spark, source, files_per_batch), checkpoint)


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The items stored so far, each once: only batches written to their end count."""
    parts = tables(spark, target)
    return spark.read.schema(SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], SCHEMA)


def received(spark: SparkSession, target: str, since: int = -1) -> DataFrame:
    """(report, n): items that have arrived of each report, in batches after ``since``."""
    parts = [f"{target}-receipts/batch={k}" for k in numbered(spark, f"{target}-receipts", "batch", since + 1)]
    rows = spark.read.schema(RECEIPTS).parquet(*parts) if parts else spark.createDataFrame([], RECEIPTS)
    return rows.groupBy("report").agg(F.sum("n").alias("n"))


class FolderReporter:
    """A reporter that hands items, with all their evaluations, to the stream as files in a folder that it watches.

    ``register`` (name, metadata) -> handle tells a server of a run; where it fails the run goes on under a handle of its own. ``target``: where the stream
    stores items; a flush waits until all that this reporter reported has arrived there. Without it, ``query``, the stream itself, is
    waited for.
    """

    def __init__(self, spark: SparkSession, folder: str, register: Callable[[str, dict[str, str]], str] | None = None, query=None, target: str | None = None):
        self.spark, self.folder, self.register, self.query, self.target = spark, folder, register, query, target
        self.completed: list[tuple[str, str]] = []
        self.waiting: dict[str, int] = {}  # reports that have not arrived in full, and their items
        self.since = -1  # the last batch before the first of them

    def start_run(self, name: str, metadata: dict[str, str]) -> str:
        if self.register is None:
            return f"{name}-{uuid.uuid4().hex[:8]}"
        try:
            return self.register(name, metadata)
        except Exception:
            return local_handle()

    def report(self, handle: str, outcome) -> None:
        order = F.struct("evaluator_idx", F.struct(F.col("evaluator").alias("name"), "score", "threshold", "success", F.coalesce("reason", F.lit("")).alias("reason")).alias("e"))
        evals = outcome.evals.groupBy("run_index", "item_idx").agg(F.avg("score").alias("score"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("evals"))
        rows = outcome.items.join(outcome.item_results(), ["run_index", "item_idx"]).join(evals, ["run_index", "item_idx"], "left")
        rows = rows.select(F.concat(F.lit(f"{handle}-"), F.col("run_index").cast("string")).alias("run_id"), "item_idx", "input", F.col("actual_output").cast("string").alias("actual_output"), "success", "score", "evals")
        self.send(rows)

    def send(self, rows: DataFrame) -> None:
        """Hand over rows of items; they count as reported once they are written."""
        if self.target and not self.waiting:
            self.since = max((int(n.removeprefix("batch=")) for n in children(self.spark, f"{self.target}-receipts")), default=0) - 1  # the last one may be under way
        report, counted = uuid.uuid4().hex, Observation()
        hand_over(rows.withColumn("report", F.lit(report)).observe(counted, F.count(F.lit(1)).alias("n")), self.folder)
        if self.target and counted.get["n"]:
            self.waiting[report] = counted.get["n"]

    def complete_run(self, handle: str, status: str) -> None:
        if not self.flush():
            warnings.warn(f"not all items of {handle} were stored in time", stacklevel=2)
        self.completed.append((handle, status))

    def flush(self, seconds: float = FLUSH_S) -> bool:
        """Wait until all that was reported is stored; False if that takes longer than ``seconds`` or the stream has ended."""
        if self.target is None:
            return self.query is None or flush(self.query, seconds)
        end = time.monotonic() + seconds
        while self.waiting:
            ended = self.query is not None and not self.query.isActive
            for r in received(self.spark, self.target, self.since).where(F.col("report").isin(list(self.waiting))).collect():
                if r.n >= self.waiting[r.report]:
                    del self.waiting[r.report]
            if self.waiting:
                if ended or time.monotonic() > end:
                    return False
                time.sleep(0.05)
        return True

    def close(self) -> None:
        if not self.flush():
            warnings.warn("not all reported items were stored in time", stacklevel=2)
        if self.query is not None:
            self.query.stop()
            self.query.awaitTermination(5)


def flush(query, seconds: float = FLUSH_S) -> bool:
    """Wait until the stream has stored all that its source holds now; False if that takes longer than ``seconds`` or the stream fails."""
    failed: list[Exception] = []

    def wait() -> None:
        try:
            query.processAllAvailable()
        except Exception as e:
            failed.append(e)

    waiting = threading.Thread(target=wait, daemon=True)
    waiting.start()
    waiting.join(seconds)
    return not waiting.is_alive() and not failed and query.exception() is None
