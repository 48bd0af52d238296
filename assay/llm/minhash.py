"""Near-duplicate documents by fast similarity sketches, bands and exact verification.

A document's sketch has ``T`` coordinates. In round i < T each shingle is
thrown into one bin with the value (i, hash); in round T + j every shingle goes
to bin j. A bin keeps its smallest value and rounds stop once all bins are
full, which the second half guarantees. Documents whose sketches agree in a
band of ``ROWS`` coordinates are compared; a pair is linked only if the full
shingle sets reach the similarity asked for.

Equal sets are one class before any pair is formed, and a band's members are
compared with one centre at a time, so a large group of copies costs rows in
proportion to its members. At similarity 0.8 a pair shares no band with a
probability of 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import Scratch, batches

T, BANDS, ROWS = 128, 32, 4
PART = 1024  # partners that a set meets in one group
WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False


def sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets into the values, distinct sorted shingle hashes of each row) of chunks of texts."""
    for i, j in tx.chunks(offsets):
        row, h = tx.shingles(tx.Words(raw, offsets, i, j, WORD), k)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
        yield i, np.searchsorted(row, np.arange(j - i + 1)), h


def sketches(at: np.ndarray, values: np.ndarray, t: int = T) -> np.ndarray:
    """One sketch of ``t`` coordinates for each set values[at[k]:at[k + 1]]; an empty set's is all ones."""
    n = len(at) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    size = np.diff(at)
    open_ = np.flatnonzero(size > 0)
    for r in range(2 * t):
        if not len(open_):
            break
        index = np.repeat(at[open_], size[open_]) + _within(size[open_])
        h = tx.mixed(values[index] ^ tx.MIX[r])
        bins = (h % np.uint64(t)).astype(np.int64) if r < t else np.full(len(h), r - t, dtype=np.int64)
        np.minimum.at(out, np.repeat(open_, size[open_]) * t + bins, (h >> np.uint64(9)) | (np.uint64(r) << np.uint64(55)))
        open_ = open_[(out.reshape(n, t)[open_] == np.iinfo(np.uint64).max).any(axis=1)]
    return out.reshape(n, t)


def _within(size: np.ndarray) -> np.ndarray:
    """0..s-1 for each s of ``size``, joined."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _sketch(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            n, keys, bands = [], [], []
            for _, at, values in sets(raw, offsets, k):
                n.append(np.diff(at))
                keys += [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                rows = sketches(at, values).reshape(len(at) - 1, BANDS, ROWS)
                bands.append(tx.mixed((rows * tx.MIX[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)))
            flat = np.concatenate(bands).astype(np.int64, copy=False).ravel() if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)],
                names=["doc_id", "n_shingles", "key", "bands"],
            )

    return run


def _sets(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            blobs = [values[a:b].tobytes() for _, at, values in sets(raw, offsets, k) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "items"])

    return run


def _verified(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * same >= percent * (len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents.

    docs: ``doc_id`` (integer) and ``text``; other columns are ignored. Two documents are
    linked if their sets of distinct ``k``-word shingles (words: runs without ASCII white
    space, A-Z in lower case; a shorter text is one shingle) have
    100 * |intersection| >= percent * |union|. ``percent`` below 80 lowers the recall of the bands.

    Returns a row per input row: doc_id, n_shingles (set size), component_id (smallest
    doc_id reachable by links, itself included), kept (doc_id = component_id).

    Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id
    are compared each by its own text and share the doc_id's component. A null doc_id keeps
    its row, with component_id null where its class has no other id. Empty table: no rows.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = scratch.save(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, key binary, bands array<long>"), "sketches")

    classes = first.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.min("n_shingles").alias("n"))
    classes = scratch.save(classes, "classes")
    members = scratch.save(classes.select("id", "n", F.explode("bands").alias("band")), "bands")

    stars = _stars(members, scratch)
    links, have = _links(docs, stars, None, k, percent, scratch, "stars")
    label = components(links, scratch, "first")
    more, have = _rest(docs, members, label, have, k, percent, scratch)
    more, _ = _links(docs, more, have, k, percent, scratch, "rest")
    label = components(links.union(more), scratch, "all")

    component = classes.select("key", "id").join(label, "id", "left").select("key", F.coalesce("component", "id").alias("class_id"))
    component = scratch.save(component, "components")
    out = first.select("doc_id", "n_shingles", "key").join(component, "key", "left").withColumn("component_id", F.coalesce("class_id", "doc_id"))
    return scratch.result(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _stars(members: DataFrame, scratch: Scratch) -> DataFrame:
    """For each band, its smallest id with each other id."""
    centre = members.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("members")).where("members > 1").select("band", "a")
    centre = scratch.save(centre, "centres")
    return scratch.save(members.join(centre, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")


def _links(docs: DataFrame, pairs: DataFrame, have: DataFrame | None, k: int, percent: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that reach the similarity on their full sets; the sets known so far.

    A document with many partners meets them in parts of about PART, each with a copy of its set.
    """
    have = _with_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), have, k, scratch, name)
    parts = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")), f"parts-{name}")
    centres = have.select(F.col("id").alias("a"), F.col("items").alias("items_a")).join(parts, "a").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")
    out = pairs.select("a", "b").join(parts, "a").withColumn("part", F.expr("pmod(xxhash64(b), parts)")).drop("parts")
    out = out.join(have.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b").join(centres, ["a", "part"])
    return scratch.save(out.select("a", "b", "items_a", "items_b").mapInArrow(_verified(percent), "a long, b long"), f"links-{name}"), have


def _with_sets(docs: DataFrame, ids: DataFrame, have: DataFrame | None, k: int, scratch: Scratch, name: str) -> DataFrame:
    """``have`` and the sets (id, items) of those ids that it lacks."""
    ids = ids.distinct()
    if have is not None:
        ids = ids.join(have.select("id"), "id", "left_anti")
    ids = scratch.save(ids, f"ids-{name}")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    new = scratch.save(texts.mapInArrow(_sets(k), "id long, items binary").where("length(items) > 0"), f"sets-{name}")
    return new if have is None else have.union(new)


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            values = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in part.column("items")]
            size = np.array([len(v) for v in values])
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.concatenate(values)), pa.array(np.repeat(size, size))], names=["id", "h", "n"])


def _rest(docs: DataFrame, members: DataFrame, label: DataFrame, have: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs that a band holds together but the stars have left in different components.

    For the documents of such bands, an exact prefix filter: shingles in order of how many
    of these documents hold them; two sets of the similarity share one among the first
    n - ceil(percent * n / 100) + 1. Sizes and positions rule out most of what is left.
    """
    labelled = members.join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    mixed = scratch.save(mixed, "mixed")
    ids = scratch.save(labelled.join(mixed, "band").select("id", "component").distinct(), "open")
    have = _with_sets(docs, ids.select("id"), have, k, scratch, "open")

    items = scratch.save(have.join(ids, "id").select("id", "items").mapInArrow(_exploded, "id long, h long, n long"), "items")
    held = scratch.save(items.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "held")
    # what no other document holds comes first in a prefix; a set with too much of it has no partner
    ranked = items.join(held, "h").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("sorted"))
    prefix = F.expr(f"n - cast(ceil({percent} * n / 100) as int) + 1 - (n - size(sorted))")
    ranked = ranked.withColumn("take", prefix).where("take > 0").select("id", "n", F.posexplode(F.expr("slice(sorted, 1, cast(take as int))")).alias("at", "s"), F.size("sorted").alias("held"))
    ranked = ranked.select("id", "n", F.col("s.h").alias("h"), F.expr("n - held + at").alias("at"))
    ranked = scratch.save(ranked.join(ids, "id"), "prefixes")
    # of a shingle's documents, those outside its largest component meet the others: each pair of two components has one of them
    held = ranked.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("most"))
    several = scratch.save(held.where("components > 1").select("h", F.col("most.component").alias("most")), "several")
    shared = scratch.save(ranked.join(several, "h"), "shared")
    fits = F.expr(
        f"x.component <> y.component and (y.component = y.most or x.id < y.id) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" and 1 + least(x.n - x.at - 1, y.n - y.at - 1) >= ceil({percent} * (x.n + y.n) / {100 + percent})"
    )
    pairs = shared.where("component <> most").alias("x").join(shared.alias("y"), F.col("x.h") == F.col("y.h")).where(fits)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return scratch.save(pairs, "open-pairs"), have
