"""Which texts lie inside which, byte by byte, without comparing all with all.

A text of eight bytes or more can lie only where its anchor lies, one of its 8-byte strings; these are 64-bit numbers and looked up
as such. If one side's size is below a bound, it goes to the executors as a table of numbers, and the other side is read
once; candidates are compared by bytes. Two large sides are joined on the rarest of a few anchors of each inner text, after a bitmap
of fixed size has cut the outer texts' strings, and candidates are compared by digests. Shorter texts are their own anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import string_bytes
from ..shared import Scratch
from ..shipping import ship

Q = 8
BOUND = 4 << 20  # bytes of a side that goes to every executor
ROWS = 200_000  # and its rows
STEP = 1 << 19  # positions looked at together
TABLE = 1 << 20
BITS, PART = 26, 1 << 15  # the bitmap's size, and the bits of one of its rows (fixed by bitmap_construct_agg)
ANCHORS = 4
LISTED = 2048  # candidates of an outer text that are verified together
MIX = np.uint64(0x9E3779B97F4A7C15)


def _numbers(raw: np.ndarray, at: np.ndarray | range) -> np.ndarray:
    """The eight bytes from each position, the first one highest; zeros beyond the end."""
    if isinstance(at, range):
        n = len(at)
        part = np.zeros(n + 2 * Q, dtype=np.uint8)
        held = raw[at.start : at.stop + Q - 1]
        part[: len(held)] = held
        out = np.empty(n, dtype=np.uint64)
        for d in range(min(Q, n)):  # every eighth number lies in the bytes as it is
            m = len(range(d, n, Q))
            out[d::Q] = part[d : d + Q * m].view(">u8")
        return out
    padded = np.concatenate([raw, np.zeros(Q, np.uint8)])
    out = padded[at].astype(np.uint64)
    for d in range(1, Q):
        out = (out << np.uint64(8)) | padded[at + d]
    return out


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return ((x ^ (x >> np.uint64(32))) * MIX) >> np.uint64(64 - bits)


def _expanded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each repetition of each element its index and its place among its own."""
    index = np.repeat(np.arange(len(count)), count)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)


class Small:
    """A bounded set of different texts, to find them in others or others in them."""

    def __init__(self, texts: list[bytes], around: bool = False):
        self.texts, self.length = texts, np.array([len(t) for t in texts], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        numbers = _numbers(self.raw, range(len(self.raw)))
        self.last = _numbers(self.raw, np.maximum(self.offsets[1:] - Q, 0))
        offset = self._anchors(numbers)
        self.keys = {}  # size of the anchor -> (table of hashes, numbers in order, first entry of each, text, offset)
        size = np.minimum(self.length, Q)
        for n in np.unique(size).tolist():
            k = np.flatnonzero(size == n)
            key = numbers[self.offsets[k] + offset[k]] >> np.uint64(64 - 8 * n)
            order = np.argsort(key, kind="stable")
            different, first = np.unique(key[order], return_index=True)
            table = np.zeros(TABLE, dtype=bool)
            table[_mixed(different, 20)] = True
            self.keys[n] = table, different, np.append(first, len(k)), k[order], offset[k][order]
        if around:
            self.order = np.argsort(numbers, kind="stable")
            self.sorted = numbers[self.order]
            self.end = np.repeat(self.offsets[1:], self.length)  # of the text that a position is in
            self.text = np.repeat(np.arange(len(texts)), self.length)

    def _anchors(self, numbers: np.ndarray) -> np.ndarray:
        """In each text the place of its rarest 8-byte string, as far as this set tells."""
        _, back, often = np.unique(numbers, return_inverse=True, return_counts=True)
        rank = often[back].astype(np.int64) << 20 | _mixed(numbers, 20).astype(np.int64)
        out = np.zeros(len(self.texts), dtype=np.int64)
        for k in np.flatnonzero(self.length > Q).tolist():
            a = self.offsets[k]
            out[k] = np.argmin(rank[a : self.offsets[k + 1] - Q + 1])
        return out

    def inside(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, text) of each text that lies in a row; as rows of an array, each once."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for a in range(int(offsets[0]), int(offsets[-1]), STEP):
            v = _numbers(raw, range(a, min(a + STEP, int(offsets[-1]))))
            for n, (table, different, first, text, offset) in self.keys.items():
                key = v >> np.uint64(64 - 8 * n)
                at = np.flatnonzero(table[_mixed(key, 20)])
                place = np.minimum(np.searchsorted(different, key[at]), len(different) - 1)
                same = different[place] == key[at]
                at, place = at[same], place[same]
                index, nth = _expanded(first[place + 1] - first[place])
                entry = first[place[index]] + nth
                k, start = text[entry], at[index] + a - offset[entry]
                row = np.searchsorted(offsets, at[index] + a, side="right") - 1
                fits = (start >= offsets[row]) & (start + self.length[k] <= offsets[row + 1])
                found.append(self._held(raw, row[fits], k[fits], start[fits]) if n == Q else np.unique(np.stack([row[fits], k[fits]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _held(self, raw: np.ndarray, row: np.ndarray, k: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Those candidates whose bytes agree; a pair that is found is not compared again."""
        if not len(row):
            return np.zeros((0, 2), dtype=np.int64)
        end = start + self.length[k] - Q
        lo = int(end.min())
        good = _numbers(raw[lo : int(end.max()) + Q], end - lo) == self.last[k]
        out: set[tuple[int, int]] = set()
        for r, t, s in zip(row[good].tolist(), k[good].tolist(), start[good].tolist(), strict=True):
            if (r, t) not in out and raw[s : s + len(self.texts[t])].tobytes() == self.texts[t]:
                out.add((r, t))
        return np.array(sorted(out), dtype=np.int64).reshape(-1, 2)

    def around(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, text) of each row, empty ones apart, that lies in a text."""
        length = np.diff(offsets)
        rows = np.flatnonzero((length > 0) & (length <= self.length.max(initial=0)))
        found = [np.zeros((0, 2), dtype=np.int64)]
        for r in rows.tolist():
            m = int(length[r])
            x = raw[offsets[r] : offsets[r + 1]].tobytes()
            n = min(m, Q)
            low = int.from_bytes(x[:n], "big") << 8 * (Q - n)
            a, b = np.searchsorted(self.sorted, [np.uint64(low)], side="left")[0], np.searchsorted(self.sorted, [np.uint64(low | (1 << 8 * (Q - n)) - 1)], side="right")[0]
            at = self.order[a:b]
            at = at[at + m <= self.end[at]]
            if m > Q:
                at = at[_numbers(self.raw, at + m - Q) == np.uint64(int.from_bytes(x[-Q:], "big"))]
                at = np.array([p for p in at.tolist() if self.raw[p : p + m].tobytes() == x], dtype=np.int64)
            k = np.unique(self.text[at])
            found.append(np.stack([np.full(len(k), r), k], axis=1))
        return np.concatenate(found)


def _texts(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("text").cast("string").alias("text")).where("text <> ''")


def _size(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return row[0], row[1]


def _scanned(small: DataFrame, large: DataFrame, inside: bool, around: bool) -> DataFrame:
    """(small, large): pairs of ids found by one pass over ``large``; ``small`` is within the bound."""
    spark = large.sparkSession
    ship(spark)
    rows = small.collect()
    numbered = {t: k for k, t in enumerate(sorted({r.text.encode() for r in rows}))}
    sent = spark.sparkContext.broadcast(list(numbered))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Small(sent.value, around)
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            found = np.unique(np.concatenate(([index.inside(raw, offsets)] if inside else []) + ([index.around(raw, offsets)] if around else [])), axis=0)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(found[:, 0])), pa.array(found[:, 1])], ["large", "k"])

    ids = small.schema["id"].dataType
    hits = large.mapInArrow(scan, f"large {large.schema['id'].dataType.simpleString()}, k long")
    names = spark.createDataFrame([(numbered[r.text.encode()], r.id) for r in rows], f"k long, small {ids.simpleString()}")
    return hits.join(F.broadcast(names), "k").select("small", "large")


def contained(inner: DataFrame, outer: DataFrame, bound: int = BOUND) -> DataFrame:
    """(inner, outer): ids of each text that lies inside another; frames (id, text).

    Null and empty texts are left out (an empty one lies inside every text). Rows that repeat give a pair each. A side of at most
    ``bound`` bytes is sent to the executors; if both are larger, anchors are joined.
    """
    inner, outer = _texts(inner), _texts(outer)
    for small, large, inside in ((inner, outer, True), (outer, inner, False)):
        n, size = _size(small)
        if not n:
            return inner.sparkSession.createDataFrame([], f"inner {inner.schema['id'].dataType.simpleString()}, outer {outer.schema['id'].dataType.simpleString()}")
        if n <= ROWS and size <= bound:
            return _scanned(small, large, inside, not inside).select(F.col("small" if inside else "large").alias("inner"), F.col("large" if inside else "small").alias("outer"))
    return _joined(inner, outer)


def either(a: DataFrame, b: DataFrame, bound: int = BOUND) -> DataFrame:
    """(a, b): ids of the pairs of which one text lies inside the other, each pair of rows once; else as :func:`contained`."""
    a, b = _texts(a), _texts(b)
    for small, large, names in ((a, b, ("small", "large")), (b, a, ("large", "small"))):
        n, size = _size(small)
        if n <= ROWS and size <= bound:
            return _scanned(small, large, True, True).select(F.col(names[0]).alias("a"), F.col(names[1]).alias("b"))
    same = F.md5(F.col("text").cast("binary"))
    one, two = a.select(same.alias("id"), "text").distinct(), b.select(same.alias("id"), "text").distinct()
    pairs = _joined(one, two).select(F.col("inner").alias("x"), F.col("outer").alias("y")).union(_joined(two, one).select("outer", "inner")).distinct()
    return pairs.join(a.select(F.col("id").alias("a"), same.alias("x")), "x").join(b.select(F.col("id").alias("b"), same.alias("y")), "y").select("a", "b")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ANCHORS 8-byte strings of each text, those of least hash in equal ranges of it; a shorter text is its own."""
    for b in batches:
        raw, offsets = string_bytes(b.column("text"))
        rows, at, size = [], [], []
        for r, (a, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if e - a <= Q:
                rows.append(r), at.append(0), size.append(e - a)
                continue
            hashes = _mixed(_numbers(raw, range(a, e - Q + 1)), 62)
            for part in np.array_split(np.arange(len(hashes)), min(ANCHORS, len(hashes))):
                rows.append(r), at.append(int(part[np.argmin(hashes[part])])), size.append(Q)
        rows, at, size = (np.array(x, dtype=np.int64) for x in (rows, at, size))
        number = _numbers(raw, offsets[rows] + at) >> (np.uint64(64) - np.uint64(8) * size.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(rows)), pa.array(np.diff(offsets)[rows]), pa.array(at), pa.array(size), pa.array(number.view(np.int64)), pa.array(_mixed(number, BITS).astype(np.int64))], ["digest", "length", "at", "size", "number", "spot"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = string_bytes(b.column("text"))
        inner, outer = [], []
        for r, (held, asked) in enumerate(zip(b.column("digest").to_pylist(), b.column("asked").to_pylist(), strict=True)):
            a, e = int(offsets[r]), int(offsets[r + 1])
            good = {x["inner"] for x in asked if a + x["start"] + x["length"] <= e and hashlib.md5(raw[a + x["start"] : a + x["start"] + x["length"]]).hexdigest() == x["inner"]}
            inner += good
            outer += [held] * len(good)
        yield pa.RecordBatch.from_arrays([pa.array(inner, pa.string()), pa.array(outer, pa.string())], ["i", "o"])


def _joined(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Both sides large: anchors of different inner texts meet the strings of different outer texts."""
    spark = inner.sparkSession
    ship(spark)
    scratch = Scratch(spark, "contained")
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    small, large = (scratch.save(df.select(digest, "text").dropDuplicates(["digest"]), n) for df, n in ((inner, "inner"), (outer, "outer")))
    anchors = scratch.save(small.mapInArrow(_anchors, "digest string, length long, at long, size long, number long, spot long"), "anchors")
    sizes = [r[0] for r in anchors.select("size").distinct().collect()]  # eight at most
    bits = anchors.groupBy("size", F.expr(f"spot div {PART}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"spot % {PART}")).alias("bits")).collect()  # 8 MB a size at most
    maps = {n: np.zeros(1 << BITS >> 3, dtype=np.uint8) for n in sizes}
    for r in bits:
        maps[r["size"]][r.part * (PART >> 3) : (r.part + 1) * (PART >> 3)] = np.frombuffer(r.bits, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(maps)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            for a in range(int(offsets[0]), int(offsets[-1]), STEP):
                v = _numbers(raw, range(a, min(a + STEP, int(offsets[-1]))))
                for n, held in sent.value.items():
                    key = v >> np.uint64(64 - 8 * n)
                    spot = _mixed(key, BITS).astype(np.int64)
                    at = np.flatnonzero(held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                    row = np.searchsorted(offsets, at + a, side="right") - 1
                    fits = at + a + n <= offsets[row + 1]
                    at, row, key = at[fits], row[fits], key[at[fits]]
                    if n < Q:  # the string is the text: where it stands does not matter
                        _, one = np.unique(np.stack([row.astype(np.uint64), key], axis=1), axis=0, return_index=True)
                        at, row, key = at[one], row[one], key[one]
                    yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(row)), pa.array(at + a - offsets[row]), pa.array(np.full(len(at), n)), pa.array(key.view(np.int64))], ["outer", "place", "size", "number"])

    held = scratch.save(large.mapInArrow(strings, "outer string, place long, size long, number long"), "strings")
    key = ["size", "number"]
    often = held.groupBy(*key).agg(F.count("*").alias("n"))
    rarest = anchors.join(often, key, "left").groupBy("digest").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), *key, "at", "length")).alias("k")).where("k.n > 0").select("digest", "k.*")
    start = F.col("place") - F.col("at")
    hits = held.join(rarest.drop("n"), key).where(start >= 0).select(F.col("digest").alias("inner"), "outer", start.alias("start"), "length")
    hits = scratch.save(hits, "hits")
    sure = hits.where(F.col("length") <= Q).select(F.col("inner").alias("i"), F.col("outer").alias("o"))
    open_ = hits.where(F.col("length") > Q)
    # a text's candidates are dealt out in lists of about LISTED, told by hash
    many = open_.groupBy("outer").agg(F.ceil(F.count("*") / LISTED).alias("lists"))
    asked = open_.join(many, "outer").withColumn("part", F.pmod(F.xxhash64("inner", "start"), F.col("lists"))).groupBy("outer", "part").agg(F.collect_list(F.struct("start", "length", "inner")).alias("asked"))
    checked = asked.join(large.withColumnRenamed("digest", "outer"), "outer").select(F.col("outer").alias("digest"), "text", "asked").mapInArrow(_verified, "i string, o string")
    pairs = scratch.result(sure.union(checked).distinct())
    ids = lambda df, name, key: df.select(F.col("id").alias(name), F.md5(F.col("text").cast("binary")).alias(key))
    return pairs.join(ids(inner, "inner", "i"), "i").join(ids(outer, "outer", "o"), "o").select("inner", "outer")
