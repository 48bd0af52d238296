"""The members of an array in one JSON file of any size, read by many tasks.

Spark reads the file as lines that end in ``}``, so it may cut it wherever it likes. What a range of the file means depends on whether it begins
inside a string and how deep; each range is first summed up for both cases, the sums are combined in order, and then every range is
read knowing where it stands. A member that runs over ranges is put together again from its parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import string_bytes
from ..shipping import ship

QUOTE, ESCAPE, END = 34, 92, 125
MEMBER = 3  # depth inside a member: root, array, member
Place = tuple[str, int]  # a range: file and first byte


def _steps(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, +1 or -1 for each that stands outside of strings and 0 for others if the bytes begin outside of one, and the number of quotes."""
    at = np.arange(len(raw))
    plain = np.maximum.accumulate(np.where(raw != ESCAPE, at, -1)) if len(raw) else at
    quotes = np.flatnonzero(raw == QUOTE)
    before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
    quotes = quotes[(quotes - 1 - before) % 2 == 0]
    places = np.flatnonzero((raw == 123) | (raw == 91) | (raw == END) | (raw == 93))
    sign = np.where((raw[places] == 123) | (raw[places] == 91), 1, -1)
    return places, np.where(np.searchsorted(quotes, places) % 2 == 0, sign, 0), len(quotes)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, np.ndarray]]:
    """The bytes of each range in order, as many parts as there are batches."""
    for b in batches:
        raw, offsets = string_bytes(b.column("value"))
        lengths, rows = np.diff(offsets), np.arange(len(b))
        out = np.full(int(lengths.sum()) + len(b), END, dtype=np.uint8)
        out[np.arange(int(lengths.sum())) + np.repeat(rows, lengths)] = raw[offsets[0] : offsets[-1]]
        ends = np.cumsum(lengths + 1)
        paths, starts = b.column("path").to_pylist(), b.column("start").to_pylist()
        first = 0
        for k in range(1, len(b) + 1):
            if k == len(b) or (paths[k], starts[k]) != (paths[first], starts[first]):
                yield (paths[first], starts[first]), out[(ends[first - 1] if first else 0) : ends[k - 1]]
                first = k


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, Iterator[np.ndarray]]]:
    from itertools import groupby

    for place, parts in groupby(_ranges(batches), key=lambda x: x[0]):
        yield place, (raw for _, raw in parts)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether its quotes are odd, and its change of depth if it begins outside of a string, and inside."""
    rows = []
    for place, parts in _by_range(batches):
        odd = outside = inside = 0
        for raw in parts:
            _, out, quotes = _steps(raw)
            _, other, _ = _steps(np.concatenate([np.array([QUOTE], np.uint8), raw]))
            out, other = int(out.sum()), int(other.sum())
            outside, inside = outside + (other if odd else out), inside + (out if odd else other)
            odd ^= quotes & 1
        rows.append((*place, odd, outside, inside))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 4))], ["path", "start", "odd", "outside", "inside"])


@dataclass
class Walk:
    """A range read from a known state: depths before and after each bracket outside of strings."""

    inside: int
    depth: int
    arrays: int  # arrays or objects in the root that have begun
    parts: list = field(default_factory=list)

    def step(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the brackets that count, and depths before and after each."""
        shift = 1 if self.inside else 0
        places, steps, quotes = _steps(np.concatenate([np.full(shift, QUOTE, np.uint8), raw]) if shift else raw)
        places, steps = places[steps != 0] - shift, steps[steps != 0]
        after = self.depth + np.cumsum(steps)
        before = after - steps
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside = (quotes & 1) if shift else self.inside ^ (quotes & 1)
        return places, before, after


def _outline(states: dict[Place, tuple[int, int]]) -> Callable:
    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range: what stands in the root itself, how many arrays or objects begin in it, and how many members begin in each of those."""
        rows = []
        for place, parts in _by_range(batches):
            walk, root, begun = Walk(*states[place], 0), [], {}
            for raw in parts:
                depth = walk.depth
                at, before, after = walk.step(raw)
                level = np.full(len(raw), depth)  # of each byte; a bracket's is the outer one
                if len(at):
                    lengths = np.diff(np.append(at, len(raw)))
                    level[at[0] :] = np.repeat(after, lengths)
                    level[at] = np.minimum(before, after)
                root.append(raw[level <= 1].tobytes())
                opens = np.flatnonzero((before == 1) & (after == 2))
                members = np.flatnonzero((before == MEMBER - 1) & (after == MEMBER))
                which = walk.arrays + np.searchsorted(opens, members)
                for w, n in zip(*np.unique(which, return_counts=True), strict=True):
                    begun[int(w)] = begun.get(int(w), 0) + int(n)
                walk.arrays += len(opens)
            rows.append((*place, b"".join(root), walk.arrays, [{"array": k, "n": n} for k, n in sorted(begun.items())]))
        kind = pa.list_(pa.struct([("array", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64(), kind))], ["path", "start", "root", "arrays", "begun"])

    return outline


def _holding(known: dict[Place, tuple[int, int, int, int]], wanted: list[int]) -> Callable:
    """``known`` as for :func:`_cutting`. What each range holds of the wanted objects of the root, between their braces."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, parts in _by_range(batches):
            inside, depth, arrays, _ = known[place]
            walk, found = Walk(inside, depth, arrays), {}
            for raw in parts:
                first, depth = walk.arrays, walk.depth
                at, before, after = walk.step(raw)
                opens = at[(before == 1) & (after == 2)]
                level = np.repeat(np.append(depth, after), np.diff(np.concatenate([[0], at, [len(raw)]])))  # of each byte
                level[at] = np.minimum(before, after)
                ends = np.concatenate([[0], opens, [len(raw)]])  # what lies between is the root's or one child's
                for k in range(len(ends) - 1):
                    if first + k in wanted:
                        part = slice(ends[k], ends[k + 1])
                        found[first + k] = found.get(first + k, b"") + raw[part][level[part] >= 2].tobytes()
                walk.arrays += len(opens)
            yield pa.RecordBatch.from_arrays([pa.array([place[0]] * len(found), pa.string()), pa.array([place[1]] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["path", "start", "nth", "text"])

    return hold


def _cutting(known: dict[Place, tuple[int, int, int, int]], wanted: int) -> Callable:
    """``known``: state, arrays begun and members of the wanted array begun before each range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, parts in _by_range(batches):
            inside, depth, arrays, nth = known[place]
            walk, rest, whole = Walk(inside, depth, arrays), [], False
            open_ = depth >= MEMBER and arrays == wanted  # a member that began before this range
            nth -= 1 if open_ else 0
            out: list[tuple[int, bool, bytes]] = []
            for raw in parts:
                at, before, after = walk.step(raw)
                opens = (before == 1) & (after == 2)
                which = walk.arrays + np.cumsum(opens)
                walk.arrays = int(which[-1]) if len(which) else walk.arrays
                mine = (which == wanted) & (((before == MEMBER - 1) & (after == MEMBER)) | ((before == MEMBER) & (after == MEMBER - 1)))
                began = 0 if open_ else None
                for k in np.flatnonzero(mine).tolist():
                    if after[k] == MEMBER:
                        began, open_, whole, rest = int(at[k]), True, True, []
                    else:
                        out.append((nth, whole, b"".join(rest) + raw[began : at[k] + 1].tobytes()))
                        began, open_, whole, rest, nth = None, False, False, [], nth + 1
                if open_:
                    rest.append(raw[began:].tobytes())
                if len(out) >= 1000:
                    yield _batch(place, out)
                    out = []
            if open_:
                out.append((nth, False, b"".join(rest)))
            # what began here and did not end, or ended here and did not begin, is a part
            yield _batch(place, out)

    return cut


def _batch(place: Place, rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["nth", "whole", "path", "start", "text"])


def members(spark: SparkSession, path: str, key: str, whole: tuple[str, ...] = ()) -> tuple[dict, DataFrame]:
    """The file's root object, with what its arrays and objects hold left out, and (nth, text) of each object or array in the array under ``key``.

    Raises ValueError for a file that is no JSON object; a member that is no JSON is told by whoever parses it. Members that are numbers, texts or
    null are left out. Objects of the root named in ``whole`` keep what they hold, at the price of one more reading of the file. The driver holds a few
    numbers a range, the root's own values and those objects.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    inside = depth = 0
    states: dict[Place, tuple[int, int]] = {}
    for r in sorted(lines.mapInArrow(_summed, "path string, start long, odd long, outside long, inside long").collect()):
        states[r.path, r.start] = inside, depth
        depth += r.inside if inside else r.outside
        inside ^= r.odd
    root, arrays, counts = [], {}, {}
    total, seen = 0, {}
    for r in sorted(lines.mapInArrow(_outline(states), "path string, start long, root binary, arrays long, begun array<struct<array:long,n:long>>").collect(), key=lambda r: (r.path, r.start)):
        root.append(bytes(r.root))
        arrays[r.path, r.start], counts[r.path, r.start] = total, {total + b["array"]: b["n"] for b in r.begun}
        total += r.arrays
    pairs: list[tuple[str, object]] = []

    def outer(found: list[tuple[str, object]]) -> dict:
        pairs[:] = found  # the last call is the root's
        return dict(found)

    text = b"".join(root).decode(errors="replace").strip()
    try:
        try:
            head = json.loads(text, object_pairs_hook=outer)
        except ValueError:
            head = json.loads(text.removesuffix("}"), object_pairs_hook=outer)  # the last line has no ``}`` of its own where the file ends in white space
    except ValueError as e:
        raise ValueError(f"Failed to parse JSON dataset: {e}") from e
    if not isinstance(head, dict):
        raise ValueError("Failed to parse JSON dataset: no object")
    wanted = n = 0
    kept = {}
    for name, v in pairs:
        n += isinstance(v, (list, dict))
        if name in whole:
            kept.pop(name, None)
            kept |= {name: n} if isinstance(v, dict) else {}
        wanted = n if name == key and isinstance(v, list) else 0 if name == key else wanted
    base, known = 0, {}
    for place in sorted(states):
        known[place] = (*states[place], arrays[place], base)
        base += counts[place].get(wanted, 0)
    if kept:
        held = sorted(lines.mapInArrow(_holding(known, list(kept.values())), "path string, start long, nth long, text binary").collect())
        try:
            head |= {name: json.loads(b"{" + b"".join(bytes(r.text) for r in held if r.nth == k) + b"}") for name, k in kept.items()}
        except ValueError as e:
            raise ValueError(f"Failed to parse JSON dataset: {e}") from e
    found = lines.mapInArrow(_cutting(known, wanted), "nth long, whole boolean, path string, start long, text binary")
    parts = found.where("not whole").groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("path", "start", "text"))).alias("p"))
    joined = parts.select("nth", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["text"])).alias("text"))
    return head, found.where("whole").select("nth", "text").union(joined).select("nth", F.col("text").cast("string").alias("text"))
