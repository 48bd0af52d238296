"""Requests on their way to a receiver: gathered by count or time, written to an outbox, sent by executors, and recorded.

A run's items wait in the stream's state until there are ten, or half a second has passed since the first of them. Each micro-batch's
requests are written to the outbox before any is sent; a batch that is tried again sends what its outbox holds and its
ledger does not. While a batch is sent, a mark in the shared folder tells a task that is tried again what was sent before it failed. Every
request has a key that goes to the receiver with it, for the moment between a sending and its mark.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import delete, numbered, written
from ..shipping import ship

BATCH, WAIT_MS = 10, 500  # items of a request, and how long the first of fewer waits
TICK = "100 milliseconds"
ATTEMPTS, BACKOFF = 3, 0.1
TASKS = 64  # that a batch's requests are dealt to at most
REQUEST = "run_id string, key string, n long, body string"
LEDGER = "key string, run_id string, n long, state string, attempts int, error string"
Receiver = Callable[[str, str, str], None]


class Refused(Exception):
    """A receiver's answer that will not change: the request is not tried again."""


def body_of(items: list[str]) -> str:
    return '{"items":[' + ",".join(items) + "]}"


def key_of(run_id: str, body: str) -> str:
    """The same for the same items of a run, whenever they are sent."""
    return hashlib.sha256(f"{run_id}\n{body}".encode()).hexdigest()[:32]


def gathered(items: DataFrame, size: int = BATCH, wait_ms: int = WAIT_MS) -> DataFrame:
    """A stream of requests (run_id, key, n, body) from a stream of items (run_id, item_idx, ...): of ``size`` items, or of fewer ``wait_ms`` after the first.

    What waits is the stream's state, so a restart loses none; a run leaves the state when nothing of it waits. A tick a second goes along with the
    items: after a restart Spark looks at what has timed out only once there is something new.
    """

    def gather(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if group[0] is None:
            yield pd.DataFrame({"run_id": [], "key": [], "n": [], "body": []}).astype({"n": "int64"})
            return
        held, since = state.get if state.exists else ([], 0)
        held, now, full = list(held), state.getCurrentProcessingTimeMs(), []
        if not state.hasTimedOut:
            new = pd.concat(list(frames)).sort_values("item_idx")["item"].tolist()
            since = since if held else now
            held += new
            while len(held) >= size:
                full.append(held[:size])
                held, since = held[size:], now
        if held and (state.hasTimedOut or now - since >= wait_ms):
            full.append(held)
            held = []
        if held:
            state.update((held, since))
            state.setTimeoutDuration(max(1, since + wait_ms - now))
        elif state.exists:
            state.remove()
        bodies = [body_of(x) for x in full]
        yield pd.DataFrame({"run_id": [group[0]] * len(full), "key": [key_of(group[0], b) for b in bodies], "n": [len(x) for x in full], "body": bodies})

    parts = items.select("run_id", "item_idx", F.to_json(F.struct(*(c for c in items.columns if c not in ("run_id", "report")))).alias("item")).where("run_id is not null")
    ticks = items.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    none = lambda c: F.lit(None).cast(parts.schema[c].dataType).alias(c)
    return parts.union(ticks.select(*map(none, parts.columns))).groupBy("run_id").applyInPandasWithState(gather, REQUEST, "held array<string>, since long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def retried(send: Callable[[], None], permanent: type[Exception] = Refused, attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> tuple[bool, int, str | None]:
    """(sent, attempts made, last error): waits grow twofold; what is refused for good is not tried again."""
    error = None
    for k in range(attempts):
        try:
            send()
            return True, k + 1, None
        except permanent as e:
            return False, k + 1, repr(e)
        except Exception as e:
            error = repr(e)
            if k + 1 < attempts:
                time.sleep(backoff * 2**k)
    return False, attempts, error


class Marks:
    """What a batch has sent so far, a small file a request; where the store cannot be reached from Python there are none, and the receiver's own keys must do."""

    def __init__(self, path: str):
        try:
            self.fs, self.path = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        except Exception:
            self.fs = None

    def has(self, key: str) -> bool:
        return self.fs is not None and self.fs.get_file_info(f"{self.path}/{key}").type == pafs.FileType.File

    def put(self, key: str) -> None:
        if self.fs is not None:
            self.fs.create_dir(self.path, recursive=True)
            with self.fs.open_output_stream(f"{self.path}/{key}"):
                pass


class Outbox:
    """Requests and what became of them: ``outbox/batch=N``, ``ledger/batch=N`` and, while a batch is sent, ``marks/batch=N``."""

    def __init__(self, spark: SparkSession, path: str, receiver: Receiver, attempts: int = ATTEMPTS, backoff: float = BACKOFF):
        self.spark, self.path, self.receiver, self.attempts, self.backoff = spark, path, receiver, attempts, backoff

    def deliver(self, requests: DataFrame, number: int) -> None:
        """Send a micro-batch's requests, each once whether or not the batch or a task is tried again; those that fail for good are dropped, on record."""
        box, ledger, marks = (f"{self.path}/{kind}/batch={number}" for kind in ("outbox", "ledger", "marks"))
        if written(self.spark, box):
            requests.write.format("noop").mode("overwrite").save()  # the state of a batch that is tried again has to be computed all the same
        else:
            requests.dropDuplicates(["key"]).write.mode("overwrite").parquet(box)
        if written(self.spark, ledger):
            return
        todo = self.spark.read.schema(REQUEST).parquet(box)
        n = todo.count()
        if n:
            self._sent(todo.repartition(min(n, TASKS), "key"), marks).write.mode("overwrite").parquet(ledger)
            delete(self.spark, marks)

    def _sent(self, requests: DataFrame, marks: str) -> DataFrame:
        ship(self.spark)
        receiver, attempts, backoff = self.receiver, self.attempts, self.backoff

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            done = Marks(marks)
            for pdf in frames:
                rows = []
                for r in pdf.itertuples():
                    ok, tried, error = (True, 0, None) if done.has(r.key) else retried(lambda r=r: receiver(r.run_id, r.body, r.key), attempts=attempts, backoff=backoff)
                    if ok and tried:
                        done.put(r.key)
                    rows.append((r.key, r.run_id, r.n, "sent" if ok else "dropped", tried, error))
                yield pd.DataFrame(rows, columns=["key", "run_id", "n", "state", "attempts", "error"])

        return requests.mapInPandas(send, LEDGER)

    def ledger(self) -> DataFrame:
        """Every request so far: key, run_id, n, state (sent or dropped), attempts and the last error of the dropped ones."""
        parts = [f"{self.path}/ledger/batch={k}" for k in numbered(self.spark, f"{self.path}/ledger", "batch")]
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER)

    def start(self, items: DataFrame, checkpoint: str, size: int = BATCH, wait_ms: int = WAIT_MS):
        """Begin to gather and send a stream of items; returns the streaming query."""
        writer = gathered(items, size, wait_ms).writeStream.outputMode("append").foreachBatch(self.deliver).option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime=TICK).start()
