"""Vectors as short codes: product quantisation whose nearest entries are found through a VA-file filter.

A codebook's entries are kept as cells, a few bits a coordinate. A table per part gives the least and the largest squared
difference of each of its coordinates to each cell, so that sums of looked-up values bound the distance to every entry; only
entries whose lower bound does not exceed the smallest upper bound are compared, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, batches

WIDEST = 1 << 25  # of an integer component: squared distances of 1,024 components fit 64 bits
ROWS = 4096  # rows that a table is made for at once
SALTS = 16
FEW_LABELS = 100_000  # as many sums are sent to all executors at most


class Cells:
    """The VA-file of one codebook: entries (k, width) in cells of 2**bits a coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        self.entries = entries
        k, width = entries.shape
        n = 1 << bits
        low = entries.min(axis=0)
        step = np.maximum(1, -(-(entries.max(axis=0) - low + 1) // n))
        self.code = (entries - low) // step
        held = self.code[:, :, None] == np.arange(n)  # entry, coordinate, cell
        # a cell reaches from its least to its largest entry; one without entries is never looked up
        self.low = np.where(held, entries[:, :, None], np.iinfo(np.int64).max).min(axis=0)
        self.high = np.where(held, entries[:, :, None], np.iinfo(np.int64).min).max(axis=0)
        self.low[~held.any(axis=0)] = self.high[~held.any(axis=0)] = 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row of ``x`` to each entry, by table lookups."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        near = np.square(np.maximum(np.maximum(below, above), 0))
        far = np.square(np.maximum(-below, -above))
        lower, upper = (np.zeros((len(x), len(self.entries)), dtype=np.int64) for _ in range(2))
        for d in range(self.code.shape[1]):
            lower += near[:, d, self.code[:, d]]
            upper += far[:, d, self.code[:, d]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (the lowest of equals) and its squared distance."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        distance = np.square(x[row] - self.entries[entry]).sum(axis=1)
        start = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, start)
        at = np.flatnonzero(distance == least[row])
        _, first = np.unique(row[at], return_index=True)
        return entry[at[first]], least


def _nearest(books: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part of each row (n, parts, width)."""
    index, distance = (np.empty(x.shape[:2], dtype=np.int64) for _ in range(2))
    for part, book in enumerate(books):
        cells = Cells(book)
        for a in range(0, len(x), ROWS):
            index[a : a + ROWS, part], distance[a : a + ROWS, part] = cells.nearest(x[a : a + ROWS, part])
    return index, distance


def _parts(b: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    z = b.column("z")
    return z.flatten().to_numpy().astype(np.int64).reshape(len(z), books.shape[0], books.shape[2])


def _gathering(books: np.ndarray) -> Callable:
    """Number and componentwise sum of the parts that each entry is nearest to; a row per part, entry and position, for a task."""
    parts, k, width = books.shape

    def gather(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64)
        for b in batches_:
            x = _parts(b, books)
            index, _ = _nearest(books, x)
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=k)
                np.add.at(total[p], index[:, p], x[:, p])
        p, e = np.nonzero(n)
        cells = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(n[p, e], width), total[p, e].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["part", "entry", "at", "n", "total"])

    return gather


def _coding(books: np.ndarray) -> Callable:
    hexed = np.array([f"{i:02x}" for i in range(books.shape[1])], dtype="U2")

    def code(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            index, distance = _nearest(books, _parts(b, books))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(["".join(r) for r in hexed[index]], pa.string()), pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return code


def compress(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): each vector's nearest entries, two hex digits a part.

    A component x counts as floor(scale * x). The codebooks start as the parts of the ``entries`` (at most 256) smallest vec_ids and
    go through ``rounds`` rounds: parts go to their nearest entry (the lowest of equals), entries become the componentwise
    floor of their parts' mean; an entry without parts stays.

    Null vectors and those that hold a null, NaN or infinity are left out. A null vec_id is the largest; rows that repeat a vec_id
    are rows, in order of their components. Null labels are one label. With fewer vectors than entries the codebooks are as short. Other columns are left aside.
    Empty table, or no vector kept: no rows. Vectors of different lengths, of a length that parts do not divide, or with a
    component of 2**25 or more are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    spark = embeddings.sparkSession
    batches(spark, rows=4096)
    scratch = Scratch(spark, "codes")
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    integer = lambda x: F.when(F.abs(value(x)) < WIDEST, value(x)).otherwise(F.raise_error(F.lit(f"a component is beyond {WIDEST // scale}")).cast("long")).cast("int")
    vectors = scratch.save(embeddings.where(whole).select("vec_id", "label", F.transform("embedding", integer).alias("z")), "vectors")
    low, high = vectors.agg(F.min(F.size("z")), F.max(F.size("z"))).first()
    shape = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if low is None:
        return scratch.result(spark.createDataFrame([], shape))
    if low != high or low % parts:
        raise ValueError(f"vectors have {low} to {high} components; all need one number that {parts} divides")
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "z").limit(entries).select("z").collect()
    books = np.array([r.z for r in first], dtype=np.int64).reshape(len(first), parts, low // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        moved = vectors.select("z").mapInArrow(_gathering(books), "part long, entry long, at long, n long, total long")
        moved = moved.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # as many rows as the codebooks have components
        books = books.copy()
        for r in moved:
            books[r.part, r.entry, r.at] = r.total // r.n
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    ids = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = scratch.save(vectors.mapInArrow(_coding(books), f"{ids}, code string, error long"), "coded")
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "sums")
    return scratch.result(_joined(coded, sums).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _joined(coded: DataFrame, sums: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """Each row with its label's sum: sums of few labels go to the rows; many are joined, each label in ``SALTS`` parts."""
    if sums.count() <= few:
        return coded.alias("c").join(F.broadcast(sums).alias("s"), F.expr("c.label <=> s.label"))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS))).alias("c")
    right = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("s")
    return left.join(right, F.expr("c.label <=> s.label and c.salt = s.salt"))
