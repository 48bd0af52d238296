"""How far sources of a language lie apart in their words, by systolic rotation.

Each (lang, source) group's smoothed word shares are cut into chunks of the language's vocabulary and stay where they are, in a
table bucketed by (lang, chunk, seat). In each round of a round-robin tournament the compressed (sparse) vectors of half the
seats travel to the seat that the schedule names; a meeting gives the distance of every resident to every visitor, in both
directions. Chunks bound what a meeting holds, whatever the vocabulary; distances add up over chunks.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, batches
from .text import LOWER, Words, buffers, chunks

TERM = np.zeros(256, dtype=bool)  # of lower-cased bytes: a-z, and all bytes of characters beyond ASCII
TERM[97:123] = TERM[128:] = True
PIECE = 1 << 18
UNIT = 1_000_000_000
SCHEMA = "lang string, source string, part string, item string, value long, rank int"
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
FOUND_DDL = "lang string, source string, part string, item string, value long"


def pieces(raw: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, offsets) of ranges of about ``limit`` bytes: several rows, or a part of one long row, cut between terms."""
    for i, j in chunks(offsets, limit):
        lo, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - lo > limit:
            gaps = np.flatnonzero(~TERM[LOWER[raw[lo : lo + limit]]])
            cut = lo + (int(gaps[-1]) + 1 if len(gaps) else limit)
            while not len(gaps) and cut < end and TERM[LOWER[raw[cut]]]:  # one term fills the range: up to its end
                cut += 1
            yield i, np.array([lo, cut], dtype=np.int64)
            lo = cut
        yield i, np.append(lo, offsets[i + 1 : j + 1])


def _summed(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """Different keys (first key first) and the sums of the values of each."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _counted(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each (lang, source) of a batch; a row without a term tells of the group itself."""
    for b in batches_:
        raw, offsets = buffers(b.column("text"))
        groups = pa.table([b.column("lang"), b.column("source")], ["lang", "source"]).to_pandas()
        code = groups.groupby(["lang", "source"], sort=False, dropna=False).ngroup().to_numpy()
        names = groups.drop_duplicates().reset_index(drop=True)
        found, texts = [], {}
        for first, bounds in pieces(raw, offsets):
            words = Words(raw, bounds, 0, len(bounds) - 1, TERM)
            (h, doc), (n,) = _summed((words.hash, words.row + first), np.ones(len(words.hash), dtype=np.int64))
            found.append((h, doc, n))
            _, at = np.unique(words.hash, return_index=True)
            for k, s, e in zip(words.hash[at].tolist(), words.start[at].tolist(), words.end[at].tolist(), strict=True):
                if k not in texts:
                    texts[k] = words.bytes[s:e].tobytes()
        h, doc, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        (h, doc), (n,) = _summed((h, doc), n)  # a long row's parts come together
        (h, group), (n, docs) = _summed((h, code[doc]), n, np.ones(len(h), dtype=np.int64))
        group = np.concatenate([group, np.arange(len(names))])
        zeros = np.zeros(len(names), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names["lang"].to_numpy()[group], pa.string()), pa.array(names["source"].to_numpy()[group], pa.string()),
             pa.array([texts[k] for k in h.tolist()] + [None] * len(names), pa.binary()), pa.array(np.append(n, zeros)), pa.array(np.append(docs, zeros))],
            ["lang", "source", "term", "n", "docs"],
        )


def _share(n: Column | str, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 v)), in decimals: exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(F.coalesce(n, F.lit(0)) + 5), wide(total + 5 * v))).cast("int")


def partner(seat: Column, turn: int, seats: int) -> Column:
    """Whom a seat meets in a round of the tournament (circle method; an even number of seats)."""
    m = seats - 1
    other = F.pmod(F.lit(2 * turn) - seat, F.lit(m))
    return F.when(seat == m, F.lit(turn)).when(other == seat, F.lit(m)).otherwise(other).cast("int")


def _dense(t: pa.Table) -> np.ndarray:
    """A row of shares per group over all terms of the chunk."""
    size = int(t.column("size")[0].as_py())
    out = np.repeat(t.column("least").to_numpy().astype(np.int64)[:, None], size, axis=1)
    idx, p = t.column("idx").combine_chunks(), t.column("p").combine_chunks()
    row = np.repeat(np.arange(len(t)), pc.list_value_length(idx).to_numpy())
    out[row, idx.flatten().to_numpy()] = p.flatten().to_numpy()
    return out


def _pairs(lang: str, a: list[str], b: list[str], distance: np.ndarray) -> pa.Table:
    """Both directions of each pair (row of a, row of b) whose distance is not negative."""
    i, j = np.nonzero(distance >= 0)
    x, y, d = np.array(a, dtype=object)[i], np.array(b, dtype=object)[j], distance[i, j]
    n = 2 * len(d)
    return pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.append(x, y), pa.string()), pa.array(["pair"] * n, pa.string()), pa.array(np.append(y, x), pa.string()), pa.array(np.append(d, d))], schema=FOUND)


def _meet(key: tuple, residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """Residents against visitors of one chunk."""
    if not len(residents) or not len(visitors):
        return FOUND.empty_table()
    x, y = _dense(residents), _dense(visitors)
    distance = np.stack([np.abs(row - y).sum(axis=1) for row in x])
    return _pairs(key[0].as_py(), residents.column("source").to_pylist(), visitors.column("source").to_pylist(), distance)


def _at_home(top: int):
    def home(key: tuple, residents: pa.Table, guide: pa.Table) -> pa.Table:
        """Residents of one seat and chunk against each other, and against the language's shares: a heap of ``top`` terms each."""
        if not len(residents):
            return FOUND.empty_table()
        lang, names = key[0].as_py(), residents.column("source").to_pylist()
        x = _dense(residents)
        distance = np.full((len(x), len(x)), -1, dtype=np.int64)
        for i in range(len(x) - 1):
            distance[i, i + 1 :] = np.abs(x[i] - x[i + 1 :]).sum(axis=1)
        out = [_pairs(lang, names, names, distance)]
        if len(guide):
            terms = guide.column("terms")[0].values.field("term")
            q = guide.column("terms")[0].values.field("q").to_numpy()
            for name, idx in zip(names, residents.column("idx"), strict=True):
                at = idx.values.to_numpy()
                gain = x[names.index(name)][at] - q[at]
                at, gain = at[gain > 0], gain[gain > 0]
                if len(gain) > top:  # those below the heap's last place need no text
                    high = gain >= np.partition(gain, len(gain) - top)[len(gain) - top]
                    at, gain = at[high], gain[high]
                best = heapq.nsmallest(top, ((-g, terms[k].as_py().encode()) for k, g in zip(at.tolist(), gain.tolist(), strict=True)))
                n = len(best)
                out.append(pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(["term"] * n, pa.string()), pa.array([t.decode() for _, t in best], pa.string()), pa.array([-g for g, _ in best], pa.int64())], schema=FOUND))
        return pa.concat_tables(out)

    return home


def audit(documents: DataFrame, least: int = 30, top: int = 50, block: int = 8, width: int = 1024) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources of a language, and the terms that mark a source.

    A language's vocabulary holds the terms of at least ``least`` of its documents. ``pair``: every other source of the language,
    by the summed difference of shares; ``term``: the ``top`` terms with the largest surplus over the language. A meeting holds
    ``block`` sources a side (more than that only adds seats and rounds) and about ``width`` terms.

    Null text, lang and source count as ''; a row is a document, also one that repeats another. A group without kept terms
    has even shares; in a language without kept terms all pairs are at 0 and there is no term. Ties are ranked by the item's
    UTF-8 bytes. Long texts are read in parts, in whole. Other columns are left aside. Empty table: no rows.
    """
    spark = documents.sparkSession
    batches(spark)
    scratch = Scratch(spark, "divergence")
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = docs.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts.withColumn("term", F.col("term").cast("string")), "counts")

    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    kept = scratch.save(kept.select("lang", "term", "n"), "kept")
    sizes = scratch.save(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total")), "sizes")
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / width)).cast("int")
    placed = kept.join(sizes, "lang").select("lang", "term", chunk.alias("chunk"), _share("n", F.col("total"), F.col("v")).alias("q"))
    nth = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    vocabulary = scratch.save(placed.withColumn("idx", nth.cast("int")), "vocabulary")

    held = scratch.save(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "chunk", "idx", "n"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left")
    member = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.save(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), member.cast("int").alias("member")), "groups")
    members = groups.agg(F.max("member")).first()[0]
    if members is None:
        return scratch.result(spark.createDataFrame([], SCHEMA))
    seats = 2 * -(-(members + 1) // (2 * block))

    vectors = held.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("x"))
    cut = vocabulary.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    cells = groups.join(cut, "lang", "left").select("lang", "source", "total", "v", F.pmod("member", F.lit(seats)).cast("int").alias("seat"), F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("size", F.lit(0)).alias("size"))
    cells = cells.join(vectors, ["lang", "source", "chunk"], "left")
    x = F.coalesce("x", F.array().cast(vectors.schema["x"].dataType))
    share = lambda n: F.when((F.col("total") + 5 * F.col("v")) > 0, _share(n, F.col("total"), F.col("v"))).otherwise(F.lit(0))
    cells = cells.select("lang", "chunk", "seat", "source", "size", share(F.lit(0).cast("long")).alias("least"), F.transform(x, lambda e: e["idx"]).alias("idx"), F.transform(x, lambda e: share(e["n"])).alias("p"))
    name = f"assay_divergence_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["lang", "chunk", "seat"]
    cells.repartition(parts, *place).write.bucketBy(parts, *place).option("path", f"{scratch.path}/cells").saveAsTable(name)
    try:
        residents = spark.table(name)
        guide = vocabulary.groupBy("lang", "chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "q", "term"))).alias("terms"))
        guide = guide.select("lang", "chunk", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("seat"), "terms")
        met = scratch.save(residents.groupBy(*place).cogroup(guide.groupBy(*place)).applyInArrow(_at_home(top), FOUND_DDL), "home")
        for turn in range(seats - 1):
            to = partner(F.col("seat"), turn, seats)
            visitors = residents.where(F.col("seat") > to).withColumn("seat", to)
            meeting = residents.groupBy(*place).cogroup(visitors.groupBy(*place)).applyInArrow(_meet, FOUND_DDL)
            met = met.union(scratch.save(meeting, f"round-{turn}"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
        marks = met.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return scratch.result(pairs.unionByName(marks).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
    finally:
        spark.sql(f"drop table if exists {name}")
        scratch._delete(f"{scratch.path}/cells")
