"""Quality classifier: naive Bayes support vectors.

Character n-gram indicators, scaled by class log-count ratios, go into a linear hinge-loss model that is fitted by
dual coordinate descent; a sigmoid turns its margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as fx
from .scratch import Scratch, batches

ORDERS, BITS = (1, 2, 3), 15
AGAIN = "\x01"


def marked(text: str) -> str:
    """The text with each word that repeats the one before it, between single spaces, replaced by a mark: repetition becomes an n-gram."""
    words = text.split(" ")
    return " ".join([words[0], *(AGAIN if b == a and b else b for a, b in zip(words, words[1:], strict=False))])


@dataclass
class Model:
    weights: np.ndarray  # hinge weights times log-count ratios
    ratio: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        f = (counts > 0).astype(np.float32)
        norm = np.sqrt(f @ (self.ratio * self.ratio))
        margin = (f @ self.weights) / np.maximum(norm, 1e-12) + self.bias
        return sigmoid(self.slope * margin + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def ratios(rows: list[np.ndarray], y: np.ndarray, dims: int, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) with p, q the smoothed numbers of texts of label 1, 0 that hold each feature."""
    p, q = np.full(dims, smooth), np.full(dims, smooth)
    for at, label in zip(rows, y, strict=True):
        (p if label else q)[at] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; labels 0/1; the bias is a constant feature; classes weigh the same."""
    w, bias = np.zeros(dims), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    most = c * len(y) / (2.0 * share[y])
    a = np.zeros(len(y))
    norms = np.array([float((x * x).sum()) + 1.0 for _, x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = sign[i] * (float(x @ w[at]) + bias) - 1.0
            new = min(max(a[i] - g / norms[i], 0.0), most[i])
            step = (new - a[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-4:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a sigmoid on the margins, by Newton's method with smoothed targets."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ v)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 1500) -> Model:
    """A model from ``most`` texts of each label."""
    scratch = Scratch(docs.sparkSession, "quality")
    chosen = scratch.save(fx.sample(labels.where(f"{label} in (0, 1)"), label, most), "chosen")
    rows = fx.sampled_texts(docs, chosen).drop("doc_id").mapInArrow(fx.sparse(ORDERS, BITS, marked), "label int, at binary, n binary").select("label", "at").collect()
    rows = sorted((r for r in rows if len(r.at)), key=lambda r: (r.label, r.at))
    y = np.array([r.label for r in rows], dtype=np.int64)
    at = [np.frombuffer(r.at, dtype=np.int32) for r in rows]
    if len(set(y.tolist())) < 2:
        ones = float(y.mean()) if len(y) else 0.5
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log((ones + 1e-3) / (1 - ones + 1e-3))))
    out = np.arange(len(rows)) % 5 == 4  # for the sigmoid
    fit = np.flatnonzero(~out)
    r = ratios([at[i] for i in fit], y[fit], 1 << BITS)
    vectors = [(k, r[k] / max(1e-12, float(np.sqrt((r[k] * r[k]).sum())))) for k in at]
    w, bias = hinge([vectors[i] for i in fit], y[fit], 1 << BITS)
    left = np.flatnonzero(out)
    margin = np.array([float(x @ w[k]) + bias for k, x in (vectors[i] for i in left)])
    slope, shift = platt(margin, y[left])
    return Model((w * r).astype(np.float32), r.astype(np.float32), bias, slope, shift)


def _scored(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in it:
            s = [model.scores(c) for _, c in fx.tables(batch, ORDERS, BITS, marked)]
            s = np.concatenate(s).astype(np.float64) if s else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, label: str = "quality", most: int = 1500) -> DataFrame:
    """The quality of every whole text of ``docs`` (doc_id, text), as ``labels`` (doc_id, ``label`` 0/1) mark it.

    Learns from labels whose crc32(doc_id as text) modulo ``folds`` is not ``out``. Returns a row per input row: doc_id,
    held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5). Null and empty texts have no n-grams and
    get the score of the bias. Without labels of both kinds every score is their share. A doc_id labelled twice counts once, as 0 if its labels differ; a null
    doc_id is scored but not learned from. Empty table: no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark, rows=512)
    known = labels.select("doc_id", F.col(label).cast("int").alias("quality")).where(F.coalesce(fx.fold("doc_id", folds) != out, F.lit(False)))
    model = train(docs.select("doc_id", F.col("text").cast("string").alias("text")), known, "quality", most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fx.fold("doc_id", folds) == out, F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double, predicted int")
