"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of
labelled texts; document frequencies come from all training texts. A temperature, fitted on a part of the sample that
training leaves out, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as fx
from .scratch import Scratch, batches

ORDERS, BITS = (1, 2, 3), 14
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (x / np.maximum(norm, 1e-12)) @ self.weights + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, dims: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims x labels) and bias of a multinomial model; ``rows`` are (buckets, values)."""
    z, n = np.zeros((dims + 1, n_labels)), np.zeros((dims + 1, n_labels))

    def solved(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, dims), np.append(x, 1.0)
            w = solved(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = solved(z, n)
    return w[:dims], w[dims]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    for _ in range(50):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, label: str = "lang", most: int = 1500) -> Model:
    """A model from ``docs`` (doc_id, text, ``label``): ``most`` texts a label are fitted, all give document frequencies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    known = docs.where(F.col(label).isNotNull())
    df = known.select(F.col("text").cast("string").alias("text")).mapInArrow(fx.frequencies(ORDERS, BITS, str.lower), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = {r.bucket: r.n for r in df.collect()}
    total = held.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1.0 + total) + 1.0)
    at = np.array(list(held), dtype=np.int64)
    idf[at] = np.log((1.0 + total) / (1.0 + np.array(list(held.values()), dtype=float))) + 1.0
    chosen = scratch.save(fx.sample(known, label, most), "chosen")
    rows = fx.sampled_texts(known.withColumn("label", F.col(label)), chosen).drop("doc_id").mapInArrow(fx.sparse(ORDERS, BITS, str.lower), "label string, at binary, n binary").collect()
    rows = sorted((r for r in rows if len(r.at)), key=lambda r: (r.label, r.at, r.n))
    labels = sorted({r.label for r in rows})
    if not labels:
        return Model([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), idf.astype(np.float32))
    y = np.array([labels.index(r.label) for r in rows])
    vectors = []
    for r in rows:
        k = np.frombuffer(r.at, dtype=np.int32)
        x = np.frombuffer(r.n, dtype=np.int32) * idf[k]
        vectors.append((k, x / np.sqrt((x * x).sum())))
    out = np.arange(len(rows)) % 5 == 4  # left out of training, for the temperature
    fit = np.flatnonzero(~out)
    w, b = ftrl([vectors[i] for i in fit], y[fit], len(labels), 1 << BITS)
    logits = np.array([x @ w[k] + b for k, x in (vectors[i] for i in np.flatnonzero(out))]).reshape(-1, len(labels))
    return Model(labels, w.astype(np.float32), b, idf.astype(np.float32), temperature(logits, y[out]))


def _predicted(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in it:
            lang, score = [], []
            for i, c in fx.tables(batch, ORDERS, BITS, str.lower):
                p = model.probabilities(c.astype(np.float32))
                best = p.argmax(axis=1)
                for r, t in enumerate(batch.column("text").slice(i, len(c)).to_pylist()):
                    letters = t is not None and any(map(str.isalpha, t))
                    lang.append(model.labels[best[r]] if letters else UNKNOWN)
                    score.append(float(p[r, best[r]]) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 3, out: int = 1, label: str = "lang", most: int = 1500) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text, ``label``).

    Learns from rows with a label whose crc32(doc_id as text) modulo ``folds`` is not ``out``. Returns a row per input row:
    doc_id, held_out, lang_pred (a learned label, or ``und`` for null and texts without letters), score (calibrated probability; 0 for ``und``).
    Without any labelled text all are ``und``. A null doc_id is not learned from and not held out. Rows that repeat are
    scored alike; of a doc_id with several labels or texts the smallest one is learned from; empty table: no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark, rows=512)
    held: Column = F.coalesce(fx.fold("doc_id", folds) == out, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).alias("lang"), held.alias("held_out"))
    model = train(rows.where("not held_out and doc_id is not null"), "lang", most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predicted(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
