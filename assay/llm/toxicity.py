"""Toxicity: non-negative positive-unlabelled learning on word features.

Confirmed toxic texts are positives; all texts, whatever their labels, are unlabelled. Words whose share differs
significantly between the two are the features of a linear model, trained in numpy, on a sample, on the class-prior-corrected risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as fx
from . import text as tx
from .quality import sigmoid
from .scratch import Scratch, batches
from .sieve import sieved

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
WORD[39] = True
PREFIXES = (4, 5, 6, 7, 8)  # bytes: insults are inflected
HELD = 1 << 18  # counted words that a task holds before it hands them on


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the feature words
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for i, j in tx.chunks(offsets):
            row, at = found(self.words, tx.Words(raw, offsets, i, j, WORD))
            z = np.bincount(row, weights=self.weights[at], minlength=j - i) if len(row) else np.zeros(j - i)
            out.append(sigmoid(z + self.bias))
        return np.concatenate(out) if out else np.empty(0)


def hashes(w: tx.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of words, then of the prefixes of each length that longer words have."""
    yield w.row, w.hash
    for n in PREFIXES:
        longer = np.flatnonzero(w.end - w.start > n)
        yield w.row[longer], tx.mixed(tx.spans(w.sums, w.start[longer], w.start[longer] + n) ^ tx.MIX[n])


def found(words: np.ndarray, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), once each, of the feature words in a range of texts."""
    if not len(words) or not len(w.hash):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(words >> np.uint64(48)).astype(np.int64)] = True
    pairs = []
    for row, h in hashes(w):
        look = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(words, h[look]), len(words) - 1)
        hit = words[at] == h[look]
        pairs.append(row[look][hit].astype(np.int64) * len(words) + at[hit])
    pair = np.unique(np.concatenate(pairs))
    return pair // len(words), pair % len(words)


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, words): the distinct hashes of each text's words and prefixes."""
    for batch in it:
        raw, offsets = tx.buffers(batch.column("text"))
        held = []
        for i, j in tx.chunks(offsets):
            w = tx.Words(raw, offsets, i, j, WORD)
            row, h = (np.concatenate(x) for x in zip(*hashes(w), strict=True))
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
            at = np.searchsorted(row, np.arange(j - i + 1))
            held += [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.binary())], names=["label", "words"])


def _held(shared):
    """(label, features): which of the feature words each text holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in it:
            held = [np.flatnonzero(np.isin(words, np.frombuffer(w.as_buffer(), dtype=np.uint64), assume_unique=True)).astype(np.int64) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.list_(pa.int64()))], names=["label", "features"])

    return run


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, a, b): in how many of a task's positives and of all its texts each word or prefix is; h null: all of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, n, m = 0, 0, 0
    for batch in it:
        raw, offsets = tx.buffers(batch.column("text"))
        positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
        n, m = n + int(positive.sum()), m + len(positive)
        for i, j in tx.chunks(offsets):
            row, h = (np.concatenate(x) for x in zip(*hashes(tx.Words(raw, offsets, i, j, WORD)), strict=True))
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            held.append(_summed([(h[once].view(np.int64), positive[i + row[once]], np.ones(int(once.sum()), dtype=np.int64))]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["h", "a", "b"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(held)], names=["h", "a", "b"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n]), pa.array([m])], names=["h", "a", "b"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, a, b = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(h, kind="stable")
    h, a, b = h[order], a[order], b[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[at], np.add.reduceat(a, at) if len(at) else a, np.add.reduceat(b, at) if len(at) else b


def select_features(counts: DataFrame, prior: float, least: float = 5.0, most: int = 4096) -> np.ndarray:
    """Words whose shares in the positives and in all texts differ by ``least`` standard errors, and which make a text that holds them
    likelier toxic than not (prior * share in positives over share in all): the ``most`` clearest, sorted.

    counts: (h, a, b), the numbers of positives and of all texts that hold h; their sizes where h is null.
    """
    size = counts.where("h is null").first()
    n, m = (max(1, size.a), max(1, size.b)) if size else (1, 1)
    held = counts.where("h is not null and a + b >= 5")
    held = held.withColumn("share", F.expr(f"(a + b + 1) / {float(n + m + 2)}D"))
    held = held.withColumn("z", F.expr(f"abs(a / {float(n)}D - b / {float(m)}D) / sqrt(share * (1 - share) * (1 / {float(n)}D + 1 / {float(m)}D))"))
    clear = held.where(f"z >= {least} and {prior} * a / {float(n)}D >= 0.5 * b / {float(m)}D").orderBy(F.desc("z"), "h").limit(most)
    return np.sort(np.array([r.h for r in clear.select("h").collect()], dtype=np.int64).view(np.uint64))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], dims: int, prior: float, rounds: int = 800, rate: float = 0.05, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias from the non-negative risk with the sigmoid loss (bounded, so no text can outweigh the others), by Adam on whole samples.

    Where the estimate of the negatives' risk falls below zero, the step goes against it, as the method asks.
    """
    w = np.zeros(dims + 1)
    w[dims] = np.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return w[:dims], float(w[dims])
    flat = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate([*s, np.empty(0, np.int64)]).astype(np.int64), len(s)) for s in (positive, unlabelled)]
    margin = lambda row, at, n: np.bincount(row, weights=w[at], minlength=n) + w[dims]
    back = lambda row, at, n, g: np.append(np.bincount(at, weights=g[row], minlength=dims), g.sum()) / n
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, rounds + 1):
        zp, zu = margin(*flat[0]), margin(*flat[1])
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = su.mean() - prior * sp.mean()
        g_negative = back(*flat[1], su * (1 - su)) - prior * back(*flat[0], sp * (1 - sp))
        g = g_negative - prior * back(*flat[0], sp * (1 - sp)) if negative >= 0 else -g_negative
        g[:dims] += l2 * w[:dims]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:dims], float(w[dims])


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, prior: float | None = None) -> Model:
    """A model of ``docs`` (doc_id, text), the training fold.

    Features are chosen from all its texts; their weights are fitted to at most ``most`` toxic and 2 * ``most`` unlabelled ones.
    The class prior is that of all labels unless given.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = scratch.save(labels, "labels")
    if prior is None:
        prior = labels.agg(F.avg("toxic")).first()[0] or 0.0
    prior = min(max(float(prior), 1e-3), 0.999)
    positive = fx.sample(labels.where("toxic = 1"), "toxic", most)
    unlabelled = fx.sample(docs.where("doc_id is not null").select("doc_id", F.lit(0).alias("toxic")).distinct(), "toxic", 2 * most)
    chosen = scratch.save(positive.union(unlabelled), "chosen")
    texts = scratch.save(fx.sampled_texts(docs, chosen).drop("doc_id").mapInArrow(_words, "label int, words binary"), "words")
    toxic = labels.where("toxic = 1").select("doc_id")
    maybe, no = sieved(docs.select("doc_id", "text"), "doc_id", toxic, scratch, "toxic-ids")
    told = maybe.join(toxic.withColumn("positive", F.lit(True)).hint("merge"), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    counts = told.union(no.select("text", F.lit(False))).mapInArrow(_counts, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    words = select_features(scratch.save(counts, "counts"), prior)
    rows = texts.mapInArrow(_held(docs.sparkSession.sparkContext.broadcast(words)), "label int, features array<long>").collect()
    at = {k: sorted(([*r.features] for r in rows if r.label == k)) for k in (1, 0)}
    at = {k: [np.array(x, dtype=np.int64) for x in v] for k, v in at.items()}
    w, bias = nnpu(at[1], at[0], len(words), prior)
    scratch.drop("labels", "chosen", "words", "toxic-ids", "counts")
    return Model(words, w, bias)


def _scored(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in it:
            s = model.scores(*tx.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _accepted(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in it:
            yield batch.filter(pa.array(model.scores(*tx.buffers(batch.column("text"))) < 0.5))

    return run


def accepted(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model of :func:`score` does not call toxic."""
    model = fitted(docs, labels, **parameters)
    return docs.mapInArrow(_accepted(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, most: int = 3000) -> Model:
    """The model of :func:`score`."""
    batches(docs.sparkSession)
    inside = F.coalesce(fx.fold("doc_id", folds) != out, F.lit(False))
    return train(docs.where(inside).select("doc_id", F.col("text").cast("string").alias("text")), labels.where(inside).select("doc_id", F.col("toxic").cast("int").alias("toxic")), most)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, most: int = 3000) -> DataFrame:
    """The toxicity of every whole text of ``docs`` (doc_id, text), as ``labels`` (doc_id, toxic 0/1) mark it.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not ``out``. Returns a row per input row: doc_id, held_out,
    score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5). Null and empty texts get the score of the
    bias. Without toxic labels all scores are the prior. A doc_id with different labels is toxic; a null doc_id is scored but not learned from;
    repeated rows are scored alike. Empty table: no rows; other columns are ignored.
    """
    model = fitted(docs, labels, folds, out, most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fx.fold("doc_id", folds) == out, F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double, predicted int")
