"""Removal of long repeated substrings by hash-compared suffix sorting.

Every ``length``-byte window has one anchor: the leftmost smallest hash among its
``GRAM``-byte substrings. Equal windows have equal anchors at equal places, so windows
need comparing only where an anchor's bytes occur twice. An anchor's context is all
that any window on it can hold. Contexts whose hashes agree are one suffix, of which the
earliest place counts; the runs of bytes that they make up with their sources are compared by
digests of the bytes, and a collision begins the work anew with other hashes. The different contexts
on one anchor are sorted as suffixes, to the right and reversed to the left, by a mergesort that compares
two suffixes by a binary search over prefix polynomial hashes. Common prefixes of neighbours, verified
byte by byte, then tell which windows are equal.

An anchor's contexts are sorted in runs of about ``RUN``, so that no anchor has to fit in a task. Runs of one anchor are
merged through their windows: each run hands on the digest of each different window with its first place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch, batches
from .sieve import sieved

GRAM = 24
RUN = 2048
SEEDS = 4  # hash functions tried before collisions are an error
PIECE = 1 << 18
LOW = np.uint64(PIECE * 2 - 1)
MISSING = -(2**63)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first row, first byte, end byte, text bounds inside): whole texts, or parts of a long one that share length - 1 bytes."""
    for i, j in tx.chunks(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= PIECE:
            yield i, lo, hi, offsets[i : j + 1]
        else:
            for a in range(lo, max(lo + 1, hi - length + 1), PIECE):
                b = min(hi, a + PIECE + length - 1)
                yield i, a, b, np.array([a, b])


def anchors(raw: np.ndarray, lo: int, hi: int, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions from ``lo``, hashes) of the anchors of all windows inside the bounds."""
    n, w = hi - lo, length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = tx.prefix(raw[lo:hi])
    at = np.arange(n - GRAM + 1)
    h = tx.mixed(tx.spans(sums, at, at + GRAM))
    key = (h & ~LOW) | at.astype(np.uint64)
    # sliding minimum over w keys: from a block's start and from its end
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(blocks, w)
    left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(table, axis=1).ravel()
    starts = n - length + 1
    best = np.minimum(left[:starts], right[w - 1 : w - 1 + starts])
    whole = np.zeros(starts + 1, dtype=np.int32)
    a, b = bounds[:-1] - lo, bounds[1:] - lo - length + 1
    ok = b > a
    np.add.at(whole, a[ok], 1)
    np.add.at(whole, b[ok], -1)
    place = (best[np.cumsum(whole[:-1]) > 0] & LOW).astype(np.int64)
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    return place, h[place]


def _second(seed: int) -> np.ndarray:
    """A 64-bit value for each byte: the hash function of contexts."""
    return np.random.Generator(np.random.PCG64(7 + seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anchored(length: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, second = length - GRAM, _second(seed)
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            for i, lo, hi, bounds in _pieces(offsets, length):
                place, h = anchors(raw, lo, hi, bounds, length)
                if not len(place):
                    continue
                row = np.searchsorted(offsets, place + lo, side="right") - 1
                # contexts may reach beyond a long text's piece
                a, b = max(int(offsets[i]), lo - reach), min(int(offsets[min(len(offsets) - 1, int(row[-1]) + 1)]), hi + length)
                up, down = tx.powers(b - a + 1)
                sums = np.zeros(b - a + 1, dtype=np.uint64)
                np.cumsum(second[raw[a:b]] * up[: b - a], out=sums[1:])
                p = place + lo
                left, right = np.maximum(offsets[row], p - reach), np.minimum(offsets[row + 1], p + length)
                ctx = (sums[right - a] - sums[left - a]) * down[left - a]
                ctx = tx.mixed(ctx + (p - left).astype(np.uint64) * tx.MIX[0] + (right - p).astype(np.uint64) * tx.MIX[1])
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), pa.array(ctx.astype(np.int64)), batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array((p - offsets[row]).astype(np.int64))],
                    names=["gram", "ctx", "doc_id", "th", "pos"],
                )

    return run


def _grams(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            for _, lo, hi, bounds in _pieces(offsets, length):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(raw, lo, hi, bounds, length)[1].astype(np.int64))], names=["gram"])

    return run


def _contexts(length: int):
    """The bytes around the anchors asked for: to the left reversed, and from the anchor to the right."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            for r, asked in enumerate(batch.column("edges").to_pylist()):
                if not asked:
                    continue
                body = raw[offsets[r] : offsets[r + 1]].tobytes()
                k = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e["gram"] for e in asked], pa.int64()),
                        pa.array([e["run"] for e in asked], pa.int64()),
                        pa.array([e["runs"] for e in asked], pa.int64()),
                        batch.column("doc_id").take(pa.array([r] * k)),
                        batch.column("th").take(pa.array([r] * k)),
                        pa.array([e["pos"] for e in asked], pa.int64()),
                        pa.array([body[max(0, e["pos"] - reach) : e["pos"]][::-1] for e in asked], pa.binary()),
                        pa.array([body[e["pos"] : e["pos"] + length] for e in asked], pa.binary()),
                    ],
                    names=["gram", "run", "runs", "doc_id", "th", "pos", "before", "after"],
                )

    return run


class Suffixes:
    """Byte strings that are sorted inside their groups, and the common prefixes of neighbours."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        self.raw, self.start, self.size = raw, offsets[:-1], np.diff(offsets)
        self.sums = tx.prefix(raw)
        self.order = self._sorted(group)
        self.common = self._verified(self.order, group)
        if self.common is None:  # a hash collision: bytes decide
            keys = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            self.order = np.array(sorted(range(len(keys)), key=lambda i: (group[i], keys[i], i)), dtype=np.int64)
            self.common = self._verified(self.order, group, checked=False)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each pair, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        a, b = self.start[x], self.start[y]
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = tx.spans(self.sums, a, a + mid) == tx.spans(self.sums, b, b + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def _after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x sorts before, with or after suffix y."""
        n = self.extension(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        last = max(0, len(self.raw) - 1)
        byte = lambda i: self.raw[np.minimum(self.start[i] + n, last)].astype(np.int64) if len(self.raw) else np.zeros(len(i), np.int64)
        return np.where(end_x & end_y, 0, np.where(end_x, -1, np.where(end_y, 1, np.sign(byte(x) - byte(y)))))

    def _sorted(self, group: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each element searches for its rank in the run beside its own."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.empty(0, np.int64)
        length = np.diff(np.append(first, n))
        begin, end = np.repeat(first, length), np.repeat(first + length, length)
        width = 1
        while len(length) and width < length.max():
            at = np.arange(n)
            block = (at - begin) // width
            mine = begin + block * width
            other = begin + (block ^ 1) * width
            stop = np.minimum(other + width, end)
            move = np.flatnonzero(other < end)
            lo, hi = other[move].copy(), stop[move].copy()
            older = (block[move] & 1) == 0  # of the left run: stays before equals
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                c = self._after(order[mid], order[move[live]])
                less = (c < 0) | ((c == 0) & ~older[live])
                lo[live] = np.where(less, mid + 1, lo[live])
                hi[live] = np.where(less, hi[live], mid)
            target = at.copy()
            target[move] = np.minimum(mine[move], other[move]) + (at[move] - mine[move]) + (lo - other[move])
            new = np.empty_like(order)
            new[target] = order
            order = new
            width *= 2
        return order

    def _verified(self, order: np.ndarray, group: np.ndarray, checked: bool = True) -> np.ndarray | None:
        """Common prefix of each suffix with the one before it in its group (-1 for the first), or None if bytes contradict the order."""
        n = len(order)
        out = np.full(n, -1, dtype=np.int64)
        if n < 2:
            return out
        x, y = order[:-1], order[1:]
        inside = np.flatnonzero(group[x] == group[y])
        x, y = x[inside], y[inside]
        width = int(self.size.max())
        for i in range(0, len(x), 4096):
            a, b = x[i : i + 4096], y[i : i + 4096]
            least = np.minimum(self.size[a], self.size[b])
            cols = np.arange(width)
            last = max(0, len(self.raw) - 1)
            va, vb = (self.raw[np.minimum(self.start[v][:, None] + cols, last)] if len(self.raw) else np.zeros((len(v), width), np.uint8) for v in (a, b))
            differ = (va != vb) | (cols >= least[:, None])
            n_same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            out[inside[i : i + 4096] + 1] = n_same
            if checked:
                k = np.minimum(n_same, max(0, width - 1))
                rows = np.arange(len(a))
                wrong = (n_same < least) & (va[rows, k] > vb[rows, k]) | (n_same == self.size[b]) & (self.size[a] > self.size[b])
                if wrong.any():
                    return None
        return out

    def classes(self, n: int) -> np.ndarray:
        """The same number for suffixes of one group that agree in their first ``n`` bytes; -1 for shorter ones."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.common < n)
        out[self.size < n] = -1
        return out


def repeats(group: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(again, first): for each context and each number of bytes before the anchor, whether an earlier context of its group
    holds the same window, and whether its window is the first.

    Contexts of a group stand together, the earliest first.
    """
    n, offsets = len(group), length - GRAM + 1
    left, right = Suffixes(*before, group), Suffixes(*after, group)
    again, first = np.zeros((n, offsets), dtype=bool), np.zeros((n, offsets), dtype=bool)
    for o in range(offsets):
        a, b = left.classes(o), right.classes(length - o)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        new = ok[np.unique(b[ok] * (n + 2) + a[ok], return_index=True)[1]]
        again[ok, o] = True
        again[new, o] = False
        first[new, o] = True
    return again, first


def ranges(again: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): byte ranges, relative to the anchor, that the windows in ``again`` make up."""
    steps = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(steps == 1)
    high = np.nonzero(steps == -1)[1] - 1
    return row, -high, length - low


_FOUND = "doc_id long, th long, low long, high long, window binary"


def _sorted_groups(length: int):
    """Ranges that repeat inside a run of contexts; for anchors of several runs also each different window of a run (its digest) at its first place."""

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.take(pa.array(np.lexsort([t.column(c).to_numpy() for c in ("pos", "th", "doc_id", "run", "gram")]))).combine_chunks()
        gram, run, pos, several = (t.column(c).to_numpy() for c in ("gram", "run", "pos", "runs"))
        group = np.cumsum(np.append(True, (gram[1:] != gram[:-1]) | (run[1:] != run[:-1])))
        before, after = tx.buffers(t.column("before")), tx.buffers(t.column("after"))
        (braw, bat), (araw, aat) = [(raw[o[0] : o[-1]], o - o[0]) for raw, o in (before, after)]
        again, first = repeats(group, (braw, bat), (araw, aat), length)
        row, low, high = ranges(again, length)
        yield _found(t, row, pos[row] + low, pos[row] + high, None)
        for r in np.flatnonzero(several > 1):
            body = braw[bat[r] : bat[r + 1]][::-1].tobytes() + araw[aat[r] : aat[r + 1]].tobytes()
            size = int(bat[r + 1] - bat[r])
            at = np.flatnonzero(first[r])
            digests = [hashlib.blake2b(body[size - o : size - o + length], digest_size=16).digest() for o in at.tolist()]
            yield _found(t, np.full(len(at), r), pos[r] - at, pos[r] - at + length, digests)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            t = pa.Table.from_batches(held)
            gram, part = t.column("gram").to_numpy(), t.column("run").to_numpy()
            last = np.flatnonzero((gram != gram[-1]) | (part != part[-1]))  # the last run may go on
            if len(last):
                yield from flush(t.slice(0, int(last[-1]) + 1))
                held = t.slice(int(last[-1]) + 1).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _found(t: pa.Table, row: np.ndarray, low: np.ndarray, high: np.ndarray, windows: list[bytes] | None) -> pa.RecordBatch:
    rows = pa.array(row)
    ids = [t.column(c).take(rows).combine_chunks() for c in ("doc_id", "th")]
    return pa.RecordBatch.from_arrays([*ids, pa.array(low), pa.array(high), pa.nulls(len(row), pa.binary()) if windows is None else pa.array(windows, pa.binary())], names=["doc_id", "th", "low", "high", "window"])


def _joined_up(length: int):
    """Equal contexts that overlap, at one distance from one source text, as runs: (doc_id, th, low, high, source, source_th, source_low)."""
    keys = ("doc_id", "th", "source", "source_th", "ahead")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 7
        for batch in it:
            cols = [batch.column(c).to_numpy() for c in (*keys, "pos", "pos")]
            cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
            *key, low, high = cols
            new = np.append(True, low[1:] - (length - GRAM) > high[:-1] + length)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            at = np.flatnonzero(new)
            runs = [k[at] for k in key] + [low[at], high[np.append(at[1:], len(low)) - 1]]
            held = [r[-1:] for r in runs]  # the last run may go on
            yield _as_runs([r[:-1] for r in runs], length)
        yield _as_runs(held, length)

    return run


def _as_runs(runs: list[np.ndarray], length: int) -> pa.RecordBatch:
    doc, th, source, source_th, ahead, low, high = runs
    low = np.maximum(0, low - (length - GRAM))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, th, low, high + length, source, source_th, low - ahead)], names=["doc_id", "th", "low", "high", "source", "source_th", "source_low"])


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a text's runs, and for the places that others' runs have as their source: (source, source_th, source_low, size, digest)."""
    for batch in it:
        raw, offsets = tx.buffers(batch.column("text"))
        rows = []
        for r, (doc, th, own, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "own", "asked")), strict=True)):
            body = raw[offsets[r] : offsets[r + 1]].tobytes()
            rows += [(e["source"], e["source_th"], e["source_low"], e["high"] - e["low"], body[e["low"] : e["high"]]) for e in own or ()]
            rows += [(doc, th, e["source_low"], e["size"], body[e["source_low"] : e["source_low"] + e["size"]]) for e in asked or ()]
        columns = [pa.array([x[k] for x in rows], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.blake2b(x[4], digest_size=16).digest() for x in rows], pa.binary())], names=["source", "source_th", "source_low", "size", "digest"])


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove marked ranges; kept_text leaves out characters that a cut has broken."""
    for batch in it:
        raw, offsets = tx.buffers(batch.column("text"))
        removed, spans, kept = [], [], []
        marks = batch.column("marks")
        for r in range(batch.num_rows):
            body = raw[offsets[r] : offsets[r + 1]]
            m = marks[r].values
            n = len(body)
            low, high = (np.clip(m.field(c).to_numpy(), 0, n) for c in ("low", "high"))
            cover = np.zeros(n + 2, dtype=np.int64)
            np.add.at(cover, low + 1, 1)
            np.add.at(cover, high + 1, -1)
            gone = np.cumsum(cover)[1:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(body[~gone].tobytes())
        texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), texts], names=["doc_id", "th", "n_removed", "n_spans", "kept", "kept_text"])


def marks(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, text, marks) of the texts of ``docs`` (doc_id, th, text) that repeat something; marks: array of byte ranges."""
    for seed in range(SEEDS):
        out = _marks(docs, length, scratch, seed)
        if out is not None:
            return out
    raise RuntimeError(f"remove_repeats: contexts collide under {SEEDS} hash functions")


def _marks(docs: DataFrame, length: int, scratch: Scratch, seed: int) -> DataFrame | None:
    """:func:`marks` by one hash function; None if contexts that it takes for equal are not."""
    grams = docs.select("text").mapInArrow(_grams(length), "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    grams = scratch.save(grams.where("n > 1").select("gram"), "grams")
    found = docs.mapInArrow(_anchored(length, seed), "gram long, ctx long, doc_id long, th long, pos long")
    found = scratch.save(found.join(grams, "gram"), "anchors")
    place = F.struct("doc_id", "th", "pos")
    firsts = scratch.save(found.groupBy("gram", "ctx").agg(F.min(place).alias("first"), F.count("*").alias("n")), "contexts")
    copies = found.join(firsts.where("n > 1"), ["gram", "ctx"]).where(place > F.col("first"))
    copies = copies.select("doc_id", "th", "pos", F.col("first.doc_id").alias("source"), F.col("first.th").alias("source_th"), (F.col("pos") - F.col("first.pos")).alias("ahead"))
    copies = copies.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "source", "source_th", "ahead", "pos")
    runs = copies.mapInArrow(_joined_up(length), "doc_id long, th long, low long, high long, source long, source_th long, source_low long")
    runs = scratch.save(runs, "runs")
    scratch.drop("anchors")

    several = scratch.save(firsts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    edges = firsts.join(several, "gram").select("gram", F.ceil(F.col("contexts") / RUN).alias("runs"), "first.*")
    edges = edges.withColumn("run", F.expr("pmod(xxhash64(doc_id, th, pos), runs)"))
    # what is wanted of each text: contexts to sort, runs that repeat a source, and places that are a source
    lists = [
        edges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "run", "runs", "pos")).alias("edges")),
        runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high", "source", "source_th", "source_low")).alias("own")),
        runs.select(F.col("source").alias("doc_id"), F.col("source_th").alias("th"), "source_low", (F.col("high") - F.col("low")).alias("size")).distinct()
        .groupBy("doc_id", "th").agg(F.collect_list(F.struct("source_low", "size")).alias("asked")),
    ]
    wanted = lists[0].join(lists[1], ["doc_id", "th"], "full").join(lists[2], ["doc_id", "th"], "full")
    wanted = scratch.save(wanted, "wanted")
    maybe, _ = sieved(docs, "doc_id", wanted, scratch, "wanted-ids")
    touched = scratch.save(maybe.join(wanted, ["doc_id", "th"]), "touched")
    key = ["source", "source_th", "source_low", "size"]
    digests = touched.where("own is not null or asked is not null").select("doc_id", "th", "text", "own", "asked").mapInArrow(_digests, "source long, source_th long, source_low long, size long, digest binary")
    if digests.groupBy(*key).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").limit(1).count():
        return None

    around = touched.where("edges is not null").select("doc_id", "th", "text", "edges").mapInArrow(_contexts(length), "gram long, run long, runs long, doc_id long, th long, pos long, before binary, after binary")
    ordered = around.repartition("gram", "run").sortWithinPartitions("gram", "run")
    sorted_ = scratch.save(ordered.mapInArrow(_sorted_groups(length), _FOUND), "sorted")
    out = sorted_.where("window is null").select("doc_id", "th", "low", "high")
    if several.where(f"contexts > {RUN}").limit(1).count():
        windows = sorted_.where("window is not null")
        where = F.struct("doc_id", "th", "low")
        earliest = scratch.save(windows.groupBy("window").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1"), "earliest")
        out = out.union(windows.join(earliest, "window").where(where > F.col("first")).select("doc_id", "th", "low", "high"))
    out = out.groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    out = scratch.save(out, "marks")
    own = F.expr("transform(own, x -> struct(x.low as low, x.high as high))").alias("own")
    mine = touched.where("own is not null or edges is not null").select("doc_id", "th", "text", own).join(out, ["doc_id", "th"], "left")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return mine.where("own is not null or found is not null").select("doc_id", "th", "text", F.concat(F.coalesce("own", none), F.coalesce("found", none)).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove from each text the bytes covered by a ``length``-byte string that also starts earlier.

    docs: ``doc_id`` (integer) and ``text``; other columns are ignored. Texts are UTF-8 bytes;
    null is empty; matches stay inside a text. Earlier: in a smaller doc_id, or in the same text at
    a smaller place. All strings are judged on the input.

    Returns a row per input row: doc_id, th (hash of the text where doc_ids repeat, else 0), n_bytes,
    n_removed, n_spans (maximal removed runs), kept_text (what is left, without characters that a cut has broken; null where
    nothing is removed, as the text then stays), kept_sha256 (of the bytes left). Rows that repeat both doc_id and text are one document and get one
    result; different texts under one doc_id come in the order of their hashes. A null doc_id
    comes before all others. Texts shorter than ``length`` stay whole. Empty table: no rows.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "substrings")
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    plain = plain.withColumn("th", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    keyed = plain.select("doc_id", "th", "text")
    marked = marks(keyed if unique else keyed.dropDuplicates(["doc_id", "th"]), length, scratch)
    cut = marked.mapInArrow(_cut, "doc_id long, th long, n_removed long, n_spans long, kept binary, kept_text string").where("n_removed > 0")
    cut = scratch.result(cut.select("doc_id", "th", "n_removed", "n_spans", "kept_text", F.sha2("kept", 256).alias("kept_sha256")))
    base = plain.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = base.join(cut, ["doc_id", "th"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("doc_id") != MISSING, F.col("doc_id")).alias("doc_id"), "th", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), "kept_text", F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
