"""Hashed character and word features of whole texts, and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

ROWS = 32  # texts in one dense table of counts


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, joined, and where each begins."""
    flat = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    at = np.append(0, np.cumsum([len(f) for f in flat]))
    return (np.concatenate(flat) if flat else np.empty(0, np.uint32)), at


def grams(points: np.ndarray, at: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of each order, in pieces of bounded size; none crosses two texts."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    step = 1 << 20
    for n in orders:
        for a in range(0, max(0, len(points) - n + 1), step):
            b = min(len(points) - n + 1, a + step)
            h = np.full(b - a, n, dtype=np.uint64)
            for d in range(n):
                h += points[a + d : b + d] * tx.MIX[d]
            inside = row[a:b] == row[a + n - 1 : b + n - 1]
            yield row[a:b][inside], (tx.mixed(h[inside]) >> np.uint64(64 - bits)).astype(np.int64)


def counts(texts: list[str | None], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Dense counts, one row of 2**bits per text: for ROWS texts at a time."""
    points, at = codes(texts)
    out = np.zeros(len(texts) << bits, dtype=np.int32)
    for row, bucket in grams(points, at, orders, bits):
        out += np.bincount((row.astype(np.int64) << bits) + bucket, minlength=len(out)).astype(np.int32) if len(out) <= 4 * len(bucket) else 0
        if len(out) > 4 * len(bucket):
            np.add.at(out, (row.astype(np.int64) << bits) + bucket, 1)
    return out.reshape(len(texts), 1 << bits)


def tables(batch: pa.RecordBatch, orders: tuple[int, ...], bits: int, change: Callable[[str], str] = str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of groups of ROWS texts of a batch."""
    for i in range(0, batch.num_rows, ROWS):
        texts = batch.column("text").slice(i, ROWS).to_pylist()
        yield i, counts([change(t) if t else "" for t in texts], orders, bits)


def frequencies(orders: tuple[int, ...], bits: int, change: Callable[[str], str] = str):
    """mapInArrow function: (bucket, n), the number of a task's texts that hold each bucket; bucket -1: all texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in it:
            n += batch.num_rows
            for _, c in tables(batch, orders, bits, change):
                held += (c > 0).sum(axis=0)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], names=["bucket", "n"])

    return run


def sparse(orders: tuple[int, ...], bits: int, change: Callable[[str], str] = str):
    """mapInArrow function: (label, at, n), the non-zero counts of each text as bytes of int32."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, n = [], []
            for _, c in tables(batch, orders, bits, change):
                for r in c:
                    k = np.flatnonzero(r)
                    at.append(k.astype(np.int32).tobytes())
                    n.append(r[k].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["label", "at", "n"])

    return run


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, label) of each label: those with the smallest hashes of doc_id, whatever order they come in.

    A doc_id counts once; of several labels it has the smallest. A bound on the hash, from the labels' counts, leaves about twice as many
    rows before they are ranked, so that the window of a label holds 2 * most + 100 rows or a little more.
    """
    spark, space = rows.sparkSession, 1 << 40
    rows = rows.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(space)))
    held = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    bounds = spark.createDataFrame([(r.label, space * min(2 * most + 100, r.n) // r.n) for r in held], f"label {rows.schema['label'].dataType.simpleString()}, below long")
    first = Window.partitionBy("label").orderBy("at", "doc_id")
    near = rows.join(F.broadcast(bounds), "label").where("at < below")
    return near.withColumn("nth", F.row_number().over(first)).where(f"nth <= {int(most)}").select("doc_id", "label")


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of a sample, a row each: where a doc_id has several texts, the smallest one.

    The sample's size is bounded, so it is sent to where the texts are. ``docs`` with a column label is joined on that too.
    """
    key = [c for c in ("doc_id", "label") if c in docs.columns]
    texts = docs.select(*key, F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), key)
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
