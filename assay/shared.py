"""Intermediate tables in the folder that every executor and the driver share.

A table written here cuts lineage and survives lost executors: it is ordinary
Parquet under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 20_000  # partitions that rows are dealt to

_own: dict[str, str] = {}
_one_at_a_time = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset: a new local folder in local mode; on a cluster an error, as no other folder is known to be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="assay-"))


def _located(spark: SparkSession, path: str):
    """Hadoop's file system and path: of any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end there."""
    return exists(spark, f"{path}/_SUCCESS")


def mark(spark: SparkSession, path: str) -> None:
    """Say that a table, written without it, has been written to its end."""
    fs, target = _located(spark, f"{path}/_SUCCESS")
    fs.create(target, True).close()


def numbered(spark: SparkSession, path: str, prefix: str, low: int | None = None, high: int | None = None) -> list[int]:
    """The numbers N, from ``low`` to ``high``, of folders ``<prefix>=N`` that hold tables written to their end, in order."""
    found = sorted(int(n.removeprefix(f"{prefix}=")) for n in children(spark, path) if n.startswith(f"{prefix}="))
    return [n for n in found if (low is None or n >= low) and (high is None or n <= high) and written(spark, f"{path}/{prefix}={n}")]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder; 0 for what a pattern names."""
    fs, target = _located(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; those that begin with a dot or an underscore apart."""
    fs, target = _located(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(n for n in names if n[0] not in "._")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole from its first moment; False if there is one. It is written aside and renamed without replacing, as Spark commits its own logs."""
    sc = spark.sparkContext
    fs, target = _located(spark, path)
    aside = sc._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    plain = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    with _one_at_a_time:  # on a local disk the look and the rename are two steps
        try:
            context.rename(aside, target, plain)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
                raise
            fs.delete(aside, False)
            return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _located(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def join_parts(spark: SparkSession, folder: str, path: str, head: str = "", tail: str = "") -> None:
    """One file of a text between two others: the bytes of a folder's part files, in order. They go through a buffer of the driver's JVM."""
    sc = spark.sparkContext
    fs, target = _located(spark, path)
    copy = sc._jvm.org.apache.hadoop.io.IOUtils
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in children(spark, folder):
            source, part = _located(spark, f"{folder}/{name}")
            stream = source.open(part)
            try:
                copy.copyBytes(stream, out, sc._jsc.hadoopConfiguration(), False)
            finally:
                stream.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _located(spark, path)
    fs.delete(target, True)


def spread(df: DataFrame, below: int = 1 << 30) -> DataFrame:
    """Rows for costly work, dealt evenly to all cores if the plan's size estimate is ``below`` so many bytes: a small file may be one row group and so one task. Larger inputs stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def dealt(df: DataFrame, *keys: str, each: int = 1 << 19, least: int | None = None, large: bool = False) -> DataFrame:
    """Rows dealt by keys so that a partition holds about ``each`` bytes of the plan's size estimate: what a task holds of groups and sorts by these keys does not grow with the input.

    There are at least as many as a join takes as they are; or ``least``, and a multiple of it, so that the last wave of tasks, and of tasks that read their files, is full. With ``large``, rows that the session's partitions hold at that size are dealt to as few as Spark finds fit."""
    spark = df.sparkSession
    size, usual = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if large and size // each <= usual:
        return df.repartition(*keys)
    if least is not None:
        return df.repartition(-(-max(1, min(size // each, MOST)) // least) * least, *keys)
    least = min(usual, max(spark.sparkContext.defaultParallelism, size >> 17))  # beneath the session's number a join deals anew
    return df.repartition(max(least, min(size // each, MOST)), *keys)


def repeats(df: DataFrame, *keys: str) -> bool:
    """Whether keys may occur twice: told from their hashes, so True may be an accident, False is certain."""
    hashes = dealt(df.select(F.xxhash64(*keys).alias("key")), "key", each=1 << 20, least=df.sparkSession.sparkContext.defaultParallelism)
    return (hashes.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1


class Scratch:
    """A folder of Parquet tables for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self._close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        if name not in self.names:
            self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy still reads."""
        for name in names:
            self._delete(f"{self.path}/{name}")
            self.names.remove(name)

    def result(self, df: DataFrame) -> DataFrame:
        """Write an operator's result and delete the tables that it was made from."""
        earlier = list(self.names)
        out = self.save(df, "result")
        self.drop(*earlier)
        return out

    def close(self) -> None:
        """Delete the folder now, if nothing lazy reads it any more."""
        self._close()
        atexit.unregister(self._close)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None and self.spark.sparkContext._jsc.sc().isStopped() is False:
            self._delete(self.path)
