"""Packing of tokenised documents into training sequences by non-negative least squares.

A document's ids are cut into full windows and a tail. Shallow combinations of tail lengths
that fill a window exactly are enumerated from the histogram of tails; non-negative least
squares gives the number of times that each is used, and the rounded-down numbers become
sequences. Tails left over are packed greedily, one after the other, cut at window ends, so
only the last sequence is padded. Only the histogram (one number per length) reaches the
driver, and the plan that goes back to the executors has at most a few rows per length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, batches

END = 1
PER_GROUP = 100_000  # rows that are ranked together
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FULL = 1 << 62  # sequences of full windows are numbered from here


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as the tokenizer file gives them, without special tokens added.

    A plain byte-level BPE file is run by tiktoken's faster implementation of the same
    merges; any other file by its own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.fast = self._tiktoken(told)
        self.width = np.uint16 if max(*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"]), END) < 1 << 16 else np.uint32
        if self.fast is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    @staticmethod
    def _tiktoken(told: dict):
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("byte_fallback"):
            return None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        plain = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [plain.get(a + b, -1) for a, b in merges]
        if order != sorted(order) or any(c not in byte for t in plain for c in t):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in plain.items()}, special_tokens=special)

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        if self.fast is None:
            yield from (e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False))
        else:
            yield from (self.fast.encode(t, allowed_special="all") if "<" in t else self.fast.encode_ordinary(t) for t in texts)


def _encoded(path: str, window: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(path), TaskContext.get().partitionId()
        row, full = part << 38, FULL + (part << 38)
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                out = {c: [] for c in ("doc_tokens", "crcs", "first", "uid", "tail", "tail_crc", "ids")}
                for ids in encoder.ids([t or "" for t in some.column("text").to_pylist()]):
                    ids = np.array([*ids, END], dtype="<u4")
                    cut = len(ids) // window * window
                    crcs = [zlib.crc32(ids[a : a + window].tobytes()) for a in range(0, cut, window)]
                    rest = ids[cut:]
                    for c, v in zip(out, (len(ids), crcs, full, row, len(rest), zlib.crc32(rest.tobytes()), rest.astype(encoder.width).tobytes()), strict=True):
                        out[c].append(v)
                    row, full = row + 1, full + len(crcs)
                types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    return run


def combinations(histogram: np.ndarray, window: int, wide: int = 64, deep: int = 16) -> list[tuple[int, ...]]:
    """Sorted length tuples of two to four parts that fill the window: all pairs, triples of the ``wide`` and fours of the ``deep`` most frequent lengths with what is missing."""
    have = {int(v) for v in np.flatnonzero(histogram)}
    common = [int(v) for v in np.argsort(-histogram, kind="stable") if histogram[v] > 0]
    out = {(a, window - a) for a in have if a <= window - a and window - a in have}
    for n, top in ((2, common[:wide]), (3, common[:deep])):
        parts: list[tuple[int, ...]] = [()]
        for _ in range(n):
            parts = [(*p, a) for p in parts for a in top if not p or a >= p[-1]]
        out |= {tuple(sorted((*p, window - sum(p)))) for p in parts if window - sum(p) in have}
    return sorted(out)


def repeats(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent: x >= 0 with the least |A x - histogram|, A's columns the combinations."""
    left = histogram.astype(float).copy()
    x = np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    norms = [float((n * n).sum()) for _, n in parts]
    for _ in range(sweeps):
        most = 0.0
        for j, (at, n) in enumerate(parts):
            step = max(-x[j], float((left[at] * n).sum()) / norms[j])
            if step:
                x[j] += step
                left[at] -= step * n
                most = max(most, abs(step))
        if most < 0.25:
            break
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """Slots (length, first rank, end rank, first sequence, offset), ranks taken per length, sequences used."""
    columns = combinations(histogram, window)
    x = repeats(histogram, columns)
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(len(left), dtype=np.int64)
    slots, sequence = [], 0
    for j in np.argsort(-x, kind="stable"):
        at, n = np.unique(columns[j], return_counts=True)
        times = int(min(np.floor(x[j] + 1e-9), (left[at] // n).min()))
        if times < 1:
            continue
        offset = 0
        for length in columns[j]:
            slots.append((length, int(taken[length]), int(taken[length]) + times, sequence, offset))
            taken[length] += times
            left[length] -= times
            offset += length
        sequence += times
    return slots, taken, sequence


def _cut(window: int, width):
    """Pieces of the tails left over: a tail starts at its place in one long stream and is cut at window ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, starts, lengths, crcs, sequences, offsets = [], [], [], [], [], []
            values = (batch.column(c).to_numpy() for c in ("doc_tokens", "tail", "place", "first_sequence"))
            for r, (n, tail, place, base, ids) in enumerate(zip(*values, batch.column("ids"), strict=True)):
                ids = np.frombuffer(ids.as_buffer(), dtype=width).astype("<u4")
                a = 0
                while a < tail:
                    at = (place + a) % window
                    b = min(tail, a + window - at)
                    for to, v in zip((rows, starts, lengths, crcs, sequences, offsets), (r, n - tail + a, b - a, zlib.crc32(ids[a:b].tobytes()), base + (place + a) // window, at), strict=True):
                        to.append(v)
                    a = b
            take = pa.array(rows, pa.int64())
            longs = (pa.array(v, pa.int64()) for v in (starts, lengths, crcs))
            ends = (pa.array(v, pa.int64()) for v in (sequences, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), *longs, batch.column("doc_tokens").take(take), *ends], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, window: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    docs: ``doc_id`` and ``text``; other columns are ignored. A document is its text's ids (null:
    none) and the end id 1; ``tokenizer`` is a tokenizers file that every executor has.

    Returns a row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (in the sequence, without gaps
    from 0). Every id is in one piece. Rows that repeat a doc_id are packed each by itself; a null doc_id is
    kept. Empty texts are one token. Empty table: no rows.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "packing")
    path = tokenizer or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _encoded(path, window), f"doc_id {kind}, doc_tokens long, crcs array<long>, first long, uid long, tail long, tail_crc long, ids binary"
    )
    encoded = scratch.save(encoded, "encoded")
    full = encoded.select("doc_id", F.posexplode("crcs").alias("i", "ids_crc32"), "first", "doc_tokens")
    full = full.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = encoded.where("tail > 0")
    salts = max(1, -(-tails.count() // PER_GROUP), 64)
    tails = tails.withColumn("salt", F.pmod(F.hash("uid"), F.lit(salts)))
    groups = scratch.save(tails.groupBy("tail", "salt").agg(F.count("*").alias("n")), "groups")
    before = F.sum("n").over(Window.partitionBy("tail").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("tail", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in scratch.spark.read.parquet(f"{scratch.path}/groups").groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[r.tail] = r.n
    slots, taken, used = plan(histogram, window)
    left = (histogram - taken) * np.arange(window)
    lengths = spark.createDataFrame([(i, int(t), int(p)) for i, (t, p) in enumerate(zip(taken, np.cumsum(left) - left, strict=True)) if histogram[i]], "tail long, taken long, stream long")
    slots = spark.createDataFrame(slots, "tail long, low long, high long, sequence long, offset long")

    rank = F.row_number().over(Window.partitionBy("tail", "salt").orderBy("uid")) - 1
    ranked = tails.withColumn("at", rank).join(F.broadcast(lengths), "tail").join(groups, ["tail", "salt"])
    ranked = ranked.select("doc_id", "doc_tokens", "tail", "tail_crc", "ids", (F.col("at") + F.col("before")).alias("rank"), "taken", "stream")
    fixed = ranked.where("rank < taken").alias("r").join(F.broadcast(slots).alias("s"), F.expr("r.tail = s.tail and r.rank >= s.low and r.rank < s.high"))
    fixed = fixed.select("doc_id", F.expr("doc_tokens - r.tail").alias("start"), F.col("r.tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens", F.expr("s.sequence + r.rank - s.low").alias("sequence_id"), "offset")
    loose = ranked.where("rank >= taken").select("doc_id", "doc_tokens", "tail", "ids", F.expr("stream + (rank - taken) * tail").alias("place"), F.lit(used).cast("long").alias("first_sequence"))
    loose = loose.mapInArrow(_cut(window, Encoder(path).width), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return scratch.result(full.union(fixed).union(loose))
