"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Every node starts with random neighbours; a round of descent brings each node's
neighbours, and those that it is a neighbour of, together, compares them with each other and keeps the best for each.
From the second round on nodes that lie close in some random projections meet too: among many vectors of a label, lists
settle far from links that no neighbour knows of. A list full of links is saturated and grows. Rounds end when few lists
change or no links are gained; an audit then compares a bounded number of vectors with all others and asks for more rounds,
longer lists, new random edges and twice as many projections while its recall is short.

The graph's edges at the threshold give components. Inside them an exact check counts links: vectors lie in blocks in order
of a projection code, two blocks whose angles prove all or none of their pairs linked are counted at once, and only the other
pairs of blocks are compared.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch, batches

LIST = 16  # length of a neighbour list that holds not only links
LONGEST = 64  # first length up to which a list of links grows
SAMPLE = 12  # of a node's neighbours, and of those it is a neighbour of, that meet in a round
BEST = 4  # partners that one meeting offers to a node, besides links
GATHER = 24  # nodes of a random meeting
SETTLED = 0.08  # share of new entries below which rounds end: links are found long before lists stand still
STILL = 1e-3  # gain of links below which rounds end, lists of more than LIST links counted as LIST
ORDERS = 4  # projections of a round
NEAR = 4e-3  # error of similarities in half precision, doubled
ROUNDS, TRIES, AUDIT = 16, 6, 1000
HOT = 100_000  # nodes of a kind that no task should have by itself
BLOCK = 256  # vectors of a block in the exact check


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _small(blobs: pa.Array) -> np.ndarray:
    """Rows of equally many half-precision numbers as a matrix of single precision."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.float16).reshape(len(blobs), -1).astype(np.float32)


def _halved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scales vectors by powers of two, so that no square overflows, and adds unit vectors in half precision: what descent moves about."""
    for batch in it:
        scaled = [np.array(v.values, dtype=np.float64) for v in batch.column("vector")]
        scaled = [np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in scaled]
        units = pa.array([_unit(x[None])[0].astype(np.float16).tobytes() for x in scaled], pa.binary())
        columns = {n: batch.column(n) for n in batch.schema.names} | {"vector": pa.array(scaled, pa.list_(pa.float64())), "unit": units}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _runs(it: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, at most ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) < 8 * size:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        *done, last = _parts(t, keys, size)
        yield from done
        held = last.combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield from _parts(pa.Table.from_batches(held).combine_chunks(), keys, size)


def _parts(t: pa.Table, keys: list[str], size: int) -> list[pa.Table]:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.append(np.flatnonzero(new), t.num_rows)
    cuts = [c for a, b in zip(starts[:-1], starts[1:], strict=True) for c in range(a, b, size)]
    return [t.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], t.num_rows], strict=True)]


def _met(keys: list[str], most: int, best: int, least: float):
    """Rows with equal keys meet: for each node the ``best`` partners of those above its floor, and all links: (a, b, sim).

    Two nodes of which neither is new to the meeting have met before.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for t in _runs(it, keys, most):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            n = len(node)
            if n < 2:
                continue
            new = np.zeros(n, dtype=bool)
            np.logical_or.at(new, np.searchsorted(node, t.column("node").to_numpy()), t.column("new").to_numpy(zero_copy_only=False))
            x = _small(t.column("unit").combine_chunks().take(pa.array(first)))
            floor = t.column("floor").to_numpy()[first]
            s = x @ x.T
            s[~(new[:, None] | new[None, :])] = -2
            np.fill_diagonal(s, -2)
            k = min(best, n - 1)
            keep = s >= least - NEAR
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            keep[np.arange(n)[:, None], top] = True
            a, b = np.nonzero(keep & (s > floor[:, None]) & (s > -1.5))
            out.append((node[a], node[b], s[a, b].astype(np.float64)))
            rows += len(a)
            if rows > 20_000:
                yield _edges(out)
                out, rows = [], 0
        yield _edges(out)

    return run


def _edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts] or [np.empty(0, t)]), type=pa.from_numpy_dtype(t)) for k, t in enumerate(kinds)], names=["a", "b", "sim"])


def _random(nodes: DataFrame, seed: int, least: float) -> DataFrame:
    """Edges (a, b, sim) of two random meetings of about GATHER nodes of a kind for each node; a kind with fewer nodes meets as a whole."""
    sizes = nodes.groupBy("kind").agg(F.count("*").alias("n")).withColumn("meetings", F.ceil(F.col("n") / GATHER))
    # kinds of over HOT nodes, at most a row in HOT, go to where their nodes are
    rows = nodes.select("kind", "node", "unit").join(F.broadcast(sizes.where(f"n > {HOT}").select("kind", "meetings")), "kind", "left")
    others = rows.where("meetings is null").drop("meetings").join(sizes.where(f"n <= {HOT}").select("kind", "meetings"), "kind")
    rows = rows.where("meetings is not null").unionByName(others).withColumn("go", F.explode(F.array(F.lit(2 * seed), F.lit(2 * seed + 1))))
    rows = rows.select("kind", "node", "unit", "go", F.expr("pmod(xxhash64(node, go), meetings)").alias("meeting"), F.lit(True).alias("new"), F.lit(-1.0).alias("floor"))
    return _grouped(rows, "kind", "go", "meeting").mapInArrow(_met(["kind", "go", "meeting"], 4 * GATHER, LIST // 2, least), "a long, b long, sim double")


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _trimmed(edges: DataFrame, longest: int, least: float, turn: int) -> DataFrame:
    """Each node's list: its LIST best, more of them while they are links, ``longest`` at most. ``go``: met in the coming round.

    edges: (a, b, sim, new), one side of each pair in a list does not call for the other.
    """
    edges = edges.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    edges = edges.withColumn("rank", F.row_number().over(best)).where(f"rank <= {LIST} or rank <= {longest} and sim >= {least - NEAR}")
    some = Window.partitionBy("a").orderBy(F.desc("new"), F.xxhash64("b", F.lit(turn)))
    return edges.withColumn("go", F.row_number().over(some) <= SAMPLE).drop("rank")


def _turned(turn: int, orders: int):
    """Rows once for each of a round's random projections (go), with a code: the coordinates that are largest after random rotations."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size = np.array([len(u) // 2 for u in batch.column("unit").to_pylist()], dtype=np.int64)
            for d, go in itertools.product(np.unique(size).tolist(), range(orders)):
                rows = batch.take(pa.array(np.flatnonzero(size == d)))
                x, code = _small(rows.column("unit")), np.zeros(rows.num_rows, dtype=np.int64)
                for axes in _axes(d, turn, go):
                    y = x @ axes
                    at = np.abs(y).argmax(axis=1)
                    code = code * 128 + 2 * at + (y[np.arange(len(y)), at] > 0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(code), go)), pa.array(code)], names=[*rows.schema.names, "go", "code"])

    return run


@functools.cache
def _axes(d: int, turn: int, go: int) -> list[np.ndarray]:
    rng = np.random.default_rng([d, turn, go])
    return [np.linalg.qr(rng.standard_normal((d, min(d, 64))))[0].astype(np.float32) for _ in range(4)]


def _projected(heads: DataFrame, turn: int, orders: int, least: float) -> DataFrame:
    """Edges (a, b, sim) of meetings of nodes of a kind that follow each other in the order of a projection's code."""
    rows = heads.mapInArrow(_turned(turn, orders), "node long, kind long, unit binary, floor double, go long, code long")
    rows = rows.repartitionByRange("go", "kind", "code", "node").sortWithinPartitions("go", "kind", "code", "node")
    return rows.withColumn("new", F.lit(True)).mapInArrow(_met(["go", "kind"], 4 * GATHER, BEST, least), "a long, b long, sim double")


def _descended(nodes: DataFrame, graph: DataFrame, longest: int, least: float, scratch: Scratch, turn: int, orders: int) -> DataFrame:
    """The lists after one round of neighbours-of-neighbours and ``orders`` projections."""
    floor = F.when(F.count("*") < LIST, -1.0).when((F.min("sim") >= least - NEAR) & (F.count("*") < longest), least - NEAR).otherwise(F.min("sim"))
    heads = nodes.select("node", "kind", "unit").join(graph.groupBy(F.col("a").alias("node")).agg(floor.alias("floor")), "node")
    heads = scratch.save(heads, f"heads-{turn + 1}")
    go = graph.where("go").select("a", "b", "new")
    back = Window.partitionBy("b").orderBy(F.desc("new"), F.xxhash64("a", F.lit(turn)))
    reverse = go.withColumn("rank", F.row_number().over(back)).where(f"rank <= {SAMPLE}").select(F.col("b").alias("at"), F.col("a").alias("node"), "new")
    meeting = go.select(F.col("a").alias("at"), F.col("b").alias("node"), "new").union(reverse).join(heads.drop("kind"), "node")
    found = _grouped(meeting.select("at", "node", "new", "unit", "floor"), "at").mapInArrow(_met(["at"], 2 * SAMPLE, BEST, least), "a long, b long, sim double")
    if orders:
        found = found.union(_projected(heads, turn, orders, least))
    merged = graph.select("a", "b", "sim", (F.col("new") & ~F.col("go")).alias("new")).union(found.withColumn("new", F.lit(True)))
    out = scratch.save(_trimmed(merged, longest, least, turn + 1), f"graph-{turn + 1}")
    scratch.drop(f"graph-{turn}", f"heads-{turn + 1}")
    return out


def _gained(graph: DataFrame, least: float) -> tuple[int, int, int, int]:
    """Threshold edges, new entries and all entries of the lists, and threshold edges with LIST of a list at most."""
    lists = graph.groupBy("a").agg(F.count_if(F.col("sim") >= least).alias("links"), F.count_if("new").alias("new"), F.count("*").alias("n"))
    return tuple(lists.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("links", "new", "n", F.least("links", F.lit(LIST))))).first())


def _same(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines in double precision of pairs (a, b, va, vb)."""
    for batch in it:
        x, y = (_matrix(batch.column(c)) for c in ("va", "vb")) if batch.num_rows else (np.empty((0, 1)),) * 2
        s = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], names=["a", "b", "sim"])


def _links(nodes: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """Threshold edges of the graph; those too near to the threshold for half precision are decided in double precision."""
    pairs = graph.where(f"sim >= {least - NEAR}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    vectors = nodes.select("node", "vector")
    near = pairs.where(f"sim < {least + NEAR}").select("a", "b")
    near = near.join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
    near = near.select("a", "b", "va", "vb").mapInArrow(_same, "a long, b long, sim double").where(f"sim >= {least}")
    return pairs.where(f"sim >= {least + NEAR}").select("a", "b").union(near.select("a", "b"))


def _audited(queries, least: float):
    """(i, n, found) for each audited vector i: its links in a task's rows, and those inside its component."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, nodes, homes, vectors = queries.value
        n, found = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        for batch in it:
            kind, node, home = (batch.column(c).to_numpy() for c in ("kind", "node", "home"))
            for k in np.unique(kind):
                mine, theirs = np.flatnonzero(kinds == k), np.flatnonzero(kind == k)
                if not len(mine):
                    continue
                x = _unit(np.array([vectors[i] for i in mine]))
                y = _unit(_matrix(batch.column("vector").take(pa.array(theirs))))
                linked = (x @ y.T >= least + 1e-9) & (nodes[mine][:, None] != node[theirs][None, :])
                n[mine] += linked.sum(axis=1)
                found[mine] += (linked & (homes[mine][:, None] == home[theirs][None, :])).sum(axis=1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(found[at])], names=["i", "n", "found"])

    return run


def _recall(counts: list[tuple[int, int]]) -> float:
    """Recall of audited vectors from (links, links found): the mean of their shares, the lower one of those with few and with many links.

    No links: 1.
    """
    means = [np.mean(s) for s in ([f / n for n, f in counts if n and (n > LIST) == many] for many in (False, True)) if s]
    return float(min(means, default=1.0))


def _audit(nodes: DataFrame, component: DataFrame, least: float) -> float:
    """Recall of AUDIT vectors, picked by hash; a link counts as found if it lies in one component, where the exact check counts it."""
    spark = nodes.sparkSession
    home = nodes.select("kind", "node", "vector").join(component.select(F.col("id").alias("node"), F.col("component").alias("home")), "node", "left").withColumn("home", F.coalesce("home", F.col("node")))
    chosen = home.orderBy(F.xxhash64("node")).limit(AUDIT).collect()
    queries = spark.sparkContext.broadcast((*(np.array([r[c] for r in chosen]) for c in ("kind", "node", "home")), [np.array(r.vector) for r in chosen]))
    each = home.mapInArrow(_audited(queries, least), "i long, n long, found long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))
    return _recall([(r.n, r.found) for r in each.collect()])


def _placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a projection code, so that vectors in order of it are close to each other."""
    for batch in it:
        code = np.zeros(batch.num_rows, dtype=np.int64)
        size = np.array([len(v) for v in batch.column("vector")], dtype=np.int64)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = _matrix(batch.column("vector").take(pa.array(rows)))
            code[rows] = (x @ np.random.default_rng(int(d)).standard_normal((int(d), 40)) > 0) @ (1 << np.arange(40, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs reach the threshold; those within rounding of it are decided as single pairs are."""
    s = (x @ y.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1))[None, :]
    for r, c in zip(*np.nonzero(np.abs(s - least) < 1e-9), strict=True):
        s[r, c] = (x[r] * y[c]).sum() / (np.sqrt((x[r] * x[r]).sum()) * np.sqrt((y[c] * y[c]).sum()))
    return s >= least


def _blocked(least: float):
    """Blocks of consecutive vectors of a component, with the links inside each block counted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(it, ["component"], BLOCK):
            x = _matrix(t.column("vector").combine_chunks())
            copies, node = t.column("copies").to_numpy(), t.column("node").to_numpy()
            linked = _linked(x, x, least)
            np.fill_diagonal(linked, False)
            unit = _unit(x)
            centre = unit.sum(axis=0)
            centre = centre / max(1e-300, float(np.sqrt(centre @ centre)))
            reach = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            row = {"component": t.column("component")[0].as_py(), "block": int(node[0]), "centre": centre.tolist(), "reach": reach, "total": int(copies.sum())}
            row |= {"nodes": node.tolist(), "copies": copies.tolist(), "within": (linked @ copies).tolist(), "vectors": x.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    return run


_longs = pa.list_(pa.int64())
_BLOCKS = pa.schema([("component", pa.int64()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("reach", pa.float64()), ("total", pa.int64()), ("nodes", _longs), ("copies", _longs), ("within", _longs), ("vectors", pa.binary())])
_BLOCKS_SQL = "component long, block long, centre array<double>, reach double, total long, nodes array<long>, copies array<long>, within array<long>, vectors binary"


def _told(least: float):
    """Pairs of blocks by what their centres and reaches prove: all pairs linked (sure), or undecided; those without links go."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = float(np.arccos(least))
        for batch in it:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("centre_a")), _matrix(batch.column("centre_b"))
            between = np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
            reach = batch.column("reach_a").to_numpy() + batch.column("reach_b").to_numpy()
            sure = between + reach < bound - 1e-6
            keep = pa.array(np.flatnonzero(between - reach <= bound + 1e-6))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b", "total_b")] + [pa.array(sure).take(keep)], names=["a", "b", "total", "sure"])

    return run


def _compared(least: float):
    """For two blocks, the copies in the second that each of the first links to: (node, n)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                nodes, copies = batch.column("nodes_a")[i].values, batch.column("copies_b")[i].values.to_numpy()
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(n, -1) for c, n in (("vectors_a", len(nodes)), ("vectors_b", len(copies))))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(_linked(x, y, least) @ copies)], names=["node", "n"])

    return run


def _counted(nodes: DataFrame, component: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, n): the rows of other nodes that each node of a component links to."""
    members = nodes.select("node", "copies", "vector").join(component.withColumnRenamed("id", "node"), "node").mapInArrow(_placed, "node long, copies long, vector array<double>, component long, code long")
    ordered = members.repartitionByRange("component", "code", "node").sortWithinPartitions("component", "code", "node")
    blocks = scratch.save(ordered.mapInArrow(_blocked(least), _BLOCKS_SQL), "blocks")
    inside = blocks.select(F.explode(F.arrays_zip("nodes", "within")).alias("x")).select(F.col("x.nodes").alias("node"), F.col("x.within").alias("n"))
    # pairs of a component's blocks, dealt by parts of its blocks so that no task has all of them
    several = blocks.groupBy("component").agg(F.count("*").alias("blocks")).where("blocks > 1").select("component", F.ceil(F.col("blocks") / 64).alias("parts"))
    heads = scratch.save(blocks.select("component", "block", "centre", "reach", "total").join(several, "component"), "heads")
    left = heads.select("component", F.col("block").alias("a"), F.col("centre").alias("centre_a"), F.col("reach").alias("reach_a"), F.expr("pmod(xxhash64(block), parts)").alias("part"))
    right = heads.select("component", F.col("block").alias("b"), F.col("centre").alias("centre_b"), F.col("reach").alias("reach_b"), F.col("total").alias("total_b"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    told = left.join(right, ["component", "part"]).where("a <> b").select("a", "b", "centre_a", "centre_b", "reach_a", "reach_b", "total_b")
    told = scratch.save(told.mapInArrow(_told(least), "a long, b long, total long, sure boolean"), "told")
    sure = told.where("sure").groupBy(F.col("a").alias("block")).agg(F.sum("total").alias("n"))
    sure = blocks.select("block", "nodes").join(sure, "block").select(F.explode("nodes").alias("node"), "n")
    rest = told.where("not sure").select("a", "b").repartition("a", "b")
    rest = rest.join(blocks.select(F.col("block").alias("a"), F.col("nodes").alias("nodes_a"), F.col("vectors").alias("vectors_a")), "a")
    rest = rest.join(blocks.select(F.col("block").alias("b"), F.col("copies").alias("copies_b"), F.col("vectors").alias("vectors_b")), "b")
    compared = rest.select("nodes_a", "vectors_a", "copies_b", "vectors_b").mapInArrow(_compared(least), "node long, n long")
    return inside.union(sure).union(compared).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.99, progress: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Links between vectors of the same label with a cosine (in double precision) of at least ``least``.

    vectors: ``vec_id`` (integer), ``embedding`` (array of numbers), ``label``; other columns are ignored.
    Null, empty and zero vectors, those with null or non-finite components, and those without a label link with nothing;
    vectors of different lengths are not compared. ``progress`` is given (round, threshold edges, new entries) of each round.

    Returns a row per input row: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id reachable by links, itself included), kept (vec_id = component_id). RuntimeError if recall stays short. Rows that repeat a vec_id count as
    vectors of their own; a null vec_id is kept only as a row. Empty table: no rows.
    """
    spark = vectors.sparkSession
    batches(spark, rows=2048)
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    sane = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
    rows = rows.withColumn("class", F.when(sane, F.md5(F.concat_ws("|", F.to_json(F.struct("label")), F.to_json(F.struct(F.transform("vector", lambda x: x + 0.0).alias("v")))))))
    rows = scratch.save(rows, "rows")
    nodes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first(F.struct("label", "vector")).alias("v"))
    nodes = nodes.select("class", "copies", "least_id", F.col("v.vector").alias("vector"), F.xxhash64("v.label", F.size("v.vector")).alias("kind"), F.monotonically_increasing_id().alias("node"))
    nodes = scratch.save(nodes.mapInArrow(_halved, "class string, copies long, least_id long, vector array<double>, kind long, node long, unit binary"), "nodes")

    longest, turn = LONGEST, 0
    graph = scratch.save(_trimmed(_random(nodes, 0, least).withColumn("new", F.lit(True)), longest, least, 0), "graph-0")
    for attempt in range(1, TRIES + 1):
        held = -1
        for k in range(ROUNDS):
            graph, turn = _descended(nodes, graph, longest, least, scratch, turn, ORDERS << attempt - 1 if turn else 0), turn + 1
            links, new, entries, gained = _gained(graph, least)
            if progress is not None:
                progress.append((turn, links, new))
            # a round without projections, or the first after new edges, tells nothing of what can still be gained
            if new <= SETTLED * entries or k > 1 and gained <= held * (1 + STILL):
                break
            held = gained
        links = scratch.save(_links(nodes, graph, least), f"links-{attempt}")
        component = components(links, scratch, f"components-{attempt}")
        found = _audit(nodes, component, least)
        if found >= recall:
            break
        if attempt == TRIES:
            raise RuntimeError(f"near_duplicates: recall {found:.4f} is under {recall} after {attempt} tries")
        # saturated lists grow, and new random edges and more projections lead out of where the lists have settled
        longest *= 2
        more = graph.drop("go").union(_random(nodes, attempt, least).withColumn("new", F.lit(True)))
        graph, turn = scratch.save(_trimmed(more, longest, least, turn + 1), f"graph-{turn + 1}"), turn + 1

    direct = scratch.save(_counted(nodes, component, least, scratch), "direct")
    members = nodes.select("node", "least_id").join(component.withColumnRenamed("id", "node"), "node")
    least_of = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = nodes.select("node", "class", "copies", "least_id").join(component.withColumnRenamed("id", "node"), "node", "left").join(least_of, "component", "left").join(direct, "node", "left")
    known = scratch.save(known.select("class", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    out = rows.select("vec_id", "class").join(known, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
