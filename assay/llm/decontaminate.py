"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (term, document, positions) for the rarest terms of the
test windows. A window's lists, each shifted by its term's place in the window, are
intersected from the rarest on; what is left is verified word by word in the text.
The index and the text are read with the test vocabulary in blocks of bounded size,
so that a large benchmark costs more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch, batches
from .sieve import sieved

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
BLOCK = 1 << 20  # test terms in one broadcast: 8 MB
SLOTS = 2  # lists intersected before the text is looked at


def _windows(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            items, phrases, terms = [], [], []
            for i, j in tx.chunks(offsets):
                w = tx.Words(raw, offsets, i, j, WORD)
                for r in np.flatnonzero(w.count):
                    lo, hi = int(w.at[r]), int(w.at[r + 1])
                    words = [w.bytes[a:b].tobytes() for a, b in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
                    h = w.hash[lo:hi].astype(np.int64)
                    for s in range(max(1, hi - lo - length + 1)):
                        items.append(i + int(r))
                        phrases.append(b" ".join(words[s : s + length]))
                        terms.append(h[s : s + length])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(items, pa.int64())), pa.array(phrases, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "phrase", "terms"])

    return run


def _find(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are in the sorted vocabulary, and where there."""
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == h)
    return hit, at[hit]


def _counts(shared, first: bool):
    """Rows (doc_id, th, n_words) for texts if ``first``, and (term, n) for each test term met."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = shared.value, np.zeros(len(shared.value), dtype=np.int64)
        small = vocabulary >> np.uint64(44)  # 20 bits: most words are ruled out by one look
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[small.astype(np.int64)] = True
        kind = pa.int64()
        for batch in it:
            kind = batch.schema.field("doc_id").type
            raw, offsets = tx.buffers(batch.column("text"))
            n = []
            for i, j in tx.chunks(offsets):
                w = tx.Words(raw, offsets, i, j, WORD)
                n.append(w.count)
                h = w.hash[maybe[(w.hash >> np.uint64(44)).astype(np.int64)]]
                np.add.at(seen, _find(vocabulary, h)[1], 1)
            if first:
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["doc_id", "th", "n_words", "term", "n"])
        met = np.flatnonzero(seen)
        none = pa.nulls(len(met), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(met), kind), none, none, pa.array(vocabulary[met].astype(np.int64)), pa.array(seen[met])], names=["doc_id", "th", "n_words", "term", "n"])

    return run


def _postings(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            for i, j in tx.chunks(offsets):
                w = tx.Words(raw, offsets, i, j, WORD)
                look = np.flatnonzero(maybe[(w.hash >> np.uint64(44)).astype(np.int64)])
                hit, at = _find(vocabulary, w.hash[look])
                hit = look[hit]
                order = np.lexsort((hit, at, w.row[hit]))
                hit, at, row = hit[order], at[order], w.row[hit][order]
                if not len(hit):
                    continue
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
                place = pa.array((hit - w.at[row]).astype(np.int32))
                rows = pa.array(row[new] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vocabulary[at[new]].astype(np.int64)), batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.ListArray.from_arrays(pa.array(np.append(new, len(hit)).astype(np.int32)), place)],
                    names=["term", "doc_id", "th", "positions"],
                )

    return run


def _verified(slop: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            asked = batch.column("candidates").to_pylist()
            n_hit, found = [], []
            for i, j in tx.chunks(offsets):
                w = tx.Words(raw, offsets, i, j, WORD)
                for r in range(j - i):
                    lo, hi = int(w.at[r]), int(w.at[r + 1])
                    hit, mine = np.zeros(hi - lo, dtype=bool), set()
                    for c in asked[i + r]:
                        for a, b in _places(w, lo, hi, c, slop):
                            hit[a:b] = True
                            mine.add(c["phrase"])
                    n_hit.append(int(hit.sum()))
                    found.append(sorted(mine))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "th", "n_hit", "phrases"])

    return run


def _places(w: tx.Words, lo: int, hi: int, c: dict, slop: int) -> list[tuple[int, int]]:
    """Where candidate ``c`` occurs in the words lo..hi: at its start, or with slop in a span around it."""
    words = c["phrase"].split(b" ")
    size, start = len(words), c["start"]
    read = lambda a, b: [w.bytes[x:y].tobytes() for x, y in zip(w.start[lo + a : lo + b], w.end[lo + a : lo + b], strict=True)]
    if not slop:
        return [(start, start + size)] if 0 <= start <= hi - lo - size and read(start, start + size) == words else []
    out, span, want = [], size + slop, sorted(words)
    for a in range(max(0, start - span + 1), min(start, hi - lo - 1) + 1):
        rest = list(want)
        for x in read(a, min(a + span, hi - lo)):
            if x in rest:
                rest.remove(x)
        if not rest:
            out.append((a, min(a + span, hi - lo)))
    return out


def occurrences(docs: DataFrame, tests: DataFrame, length: int = 13, slop: int = 0) -> DataFrame:
    """Per document, the test windows that occur in it.

    docs: ``doc_id`` and ``text``; tests: ``item_id`` and ``text``; other columns are ignored.
    Words are runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters. A window is
    ``length`` consecutive words of a test text; a shorter one, if not empty, is one window.
    With ``slop`` 0 a window occurs as an exact phrase; else all its words, in any order,
    must lie within its length + slop words.

    Returns a row per input row of docs: doc_id, n_words, n_hit (words inside occurrences),
    item_ids (array of the tests' ids as sorted strings). Null and empty texts have no words and no
    hits; a null item_id names no item, but its words count as hit; rows that repeat a doc_id are
    looked at each by its own text; a repeated test row adds nothing. Empty tables: no hits.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "decontaminate")
    keyed = docs.select("doc_id", F.col("text").cast("string"), F.xxhash64("text").alias("th"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = tests.schema["item_id"].dataType.simpleString()
    every = tests.select("item_id", F.col("text").cast("string")).mapInArrow(_windows(length), f"item_id {item_type}, phrase binary, terms array<long>").distinct()
    every = scratch.save(every, "windows")
    windows = every.select("phrase", "terms").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = scratch.save(windows, "phrases")
    places = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))

    counted = _passes(spark, keyed, places.select("term").distinct(), scratch, id_type)
    words = counted.where("n_words is not null").select("doc_id", "th", "n_words")
    counts = counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    by_rarity = Window.partitionBy("window").orderBy("n", "offset")
    slots = places.join(counts, "term").withColumn("rank", F.row_number().over(by_rarity)).withColumn("known", F.count("*").over(Window.partitionBy("window")))
    slots = scratch.save(slots.where(F.expr(f"known = size and rank <= {1 if slop else SLOTS}")).select("window", "rank", "term", "offset"), "slots")

    postings = None
    for block in _blocks(spark, slots.select("term").distinct(), scratch, "chosen"):
        part = keyed.mapInArrow(_postings(block), f"term long, doc_id {id_type}, th long, positions array<int>")
        postings = part if postings is None else postings.union(part)
    postings = scratch.save(postings, "postings")
    first = slots.where("rank = 1").withColumnRenamed("offset", "at")
    start = F.col("position") - (F.lit(0) if slop else F.col("at"))
    met = postings.join(first, "term").select("window", "doc_id", "th", F.explode("positions").alias("position"), "at").select("window", "doc_id", "th", start.alias("start")).where("start >= 0")
    for rank in range(2, (1 if slop else SLOTS) + 1):
        # the next list, shifted to the start: a window without so many words keeps its candidates
        more = slots.where(f"rank = {rank}").select("window", F.col("term").alias("next"), F.col("offset").alias("at"))
        met = scratch.save(met.join(more, "window", "left"), f"met-{rank}")
        kept = met.alias("m").join(postings.alias("p").hint("merge"), F.expr("p.term = m.next and p.doc_id <=> m.doc_id and p.th = m.th and array_contains(p.positions, m.start + m.at)"), "left_semi")
        met = kept.union(met.where("next is null")).select("window", "doc_id", "th", "start")
    met = met.join(windows.select("window", "phrase"), "window").groupBy("doc_id", "th").agg(F.collect_list(F.struct("phrase", "start")).alias("candidates"))
    met = scratch.save(met, "candidates")

    # only texts that may hold a candidate move; both sides grow with the corpus: the plan is the same at every size
    maybe, _ = sieved(keyed, "th", met, scratch, "candidate-ids")
    seen = maybe.alias("t").join(met.alias("m").hint("merge"), F.expr("t.doc_id <=> m.doc_id and t.th = m.th")).select("t.doc_id", "t.th", "t.text", "m.candidates")
    hits = scratch.save(seen.mapInArrow(_verified(slop), f"doc_id {id_type}, th long, n_hit long, phrases array<binary>").distinct(), "hits")
    owners = every.where("item_id is not null").select("phrase", F.col("item_id").cast("string").alias("item"))
    items = hits.select("doc_id", "th", F.explode("phrases").alias("phrase")).distinct().join(owners, "phrase").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    items = scratch.save(hits.alias("h").join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id and h.th = i.th"), "left").select("h.doc_id", "h.th", "h.n_hit", "i.item_ids"), "found")
    out = words.alias("w").join(items.alias("i"), F.expr("w.doc_id <=> i.doc_id and w.th = i.th"), "left")
    return scratch.result(out.select("w.doc_id", "w.n_words", F.coalesce("i.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("i.item_ids", F.array().cast("array<string>")).alias("item_ids")))


def _blocks(spark, terms: DataFrame, scratch: Scratch, name: str) -> Iterator:
    """The terms as sorted arrays of about BLOCK at most, each broadcast; one empty array if there are none."""
    terms = scratch.save(terms, name)
    n = max(1, -(-terms.count() // BLOCK))
    for k in range(n):
        rows = terms.where(F.expr(f"pmod(term, {n}) = {k}")).toPandas()["term"].to_numpy(dtype=np.int64)
        yield spark.sparkContext.broadcast(np.sort(rows.astype(np.uint64)))


def _passes(spark, keyed: DataFrame, terms: DataFrame, scratch: Scratch, id_type: str) -> DataFrame:
    """Word counts of all texts and numbers of postings of the test terms."""
    out = None
    for k, block in enumerate(_blocks(spark, terms, scratch, "vocabulary")):
        part = keyed.mapInArrow(_counts(block, k == 0), f"doc_id {id_type}, th long, n_words long, term long, n long")
        out = part if out is None else out.union(part)
    return scratch.save(out, "counted")


def contamination(docs: DataFrame, tests: DataFrame, length: int = 13, slop: int = 0) -> DataFrame:
    """:func:`occurrences` with n_items, items_sha256 (of the comma-joined item_ids) and contaminated (n_hit > 0)."""
    found = occurrences(docs, tests, length, slop)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
