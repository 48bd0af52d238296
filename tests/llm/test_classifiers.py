"""Language, quality and toxicity: held-out accuracy, what may be learned from, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import features, langid, quality, toxicity
from assay.llm import text as tx

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_language_held_out(spark, tables):
    docs = tables["documents"].where("doc_id % 4 = 0")
    got = langid.identify(docs, most=300).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, low = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score")).first()
    assert n > 500 and right > 0.99 and low > 0


def test_quality_held_out(spark, tables):
    got = quality.score(tables["documents"].join(tables["labels"].select("doc_id"), "doc_id"), tables["labels"], most=500).join(tables["labels"], "doc_id").where("held_out and quality is not null")
    rates = {r.quality: r.a for r in got.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a")).collect()}
    assert rates[0] > 0.95 and rates[1] > 0.95


def test_toxicity_held_out(spark, tables):
    got = toxicity.score(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").where("held_out and toxic is not null")
    rates = {r.toxic: r.a for r in got.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("a")).collect()}
    assert rates[0] > 0.99 and rates[1] > 0.8


DOCS = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_edges(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 3, "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "fr", "x"), (102, "123 !?", "en", "x"), (None, "the mat", None, "x"), (1, rows[1][1], None, "x"), (103, "the cat " * 100_000, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.score > 0): r for r in langid.identify(docs).collect()}
    assert [got[k].lang_pred for k in ((100, False), (101, False), (102, False), (None, True), (103, True))] == ["und", "und", "und", "en", "en"]
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(60)] + [(None, 1, 1, "x"), (3, 1, 1, "x"), (70, None, None, "x")], LABELS)
    for scored in (quality.score(docs, labels), toxicity.score(docs, labels)):
        out = scored.collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert {r.held_out for r in out if r.doc_id is None} == {False}
    none = spark.createDataFrame([], DOCS)
    no_labels = spark.createDataFrame([], LABELS)
    assert langid.identify(none).collect() == quality.score(none, labels).collect() == toxicity.score(none, labels).collect() == []
    for scored in (quality.score(docs, no_labels), toxicity.score(docs, no_labels)):
        assert scored.count() == len(rows)


def small(tables):
    docs = tables["documents"].where("doc_id < 1500")
    return docs, tables["labels"].where("doc_id < 1500")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select("doc_id", *columns).collect())


def test_held_out_labels_and_other_columns_are_not_read(spark, tables):
    """Turned held-out labels, other languages of held-out documents and other sources change no score."""
    docs, labels = small(tables)
    out3, out5 = features.fold("doc_id", 3) == 1, features.fold("doc_id", 5) == 0
    turned = docs.withColumn("lang", F.when(out3, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    assert rows_of(langid.identify(docs, most=100), "lang_pred", "score") == rows_of(langid.identify(turned, most=100), "lang_pred", "score")
    flipped = labels.withColumn("quality", F.when(out3, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(out5, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(quality.score(docs, labels, most=100), "score") == rows_of(quality.score(turned, flipped, most=100), "score")
    prior = labels.where(~out5).agg(F.avg("toxic")).first()[0]
    assert 0 < prior < 0.5
    assert rows_of(toxicity.score(docs, labels), "score") == rows_of(toxicity.score(turned, flipped), "score")


M = (1 << 64) - 1


def mixed(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def naive_counts(text, orders, bits):
    out = {}
    for n in orders:
        for i in range(len(text) - n + 1):
            h = mixed((n + sum(ord(c) * int(features.tx.MIX[d]) for d, c in enumerate(text[i : i + n]))) & M) >> (64 - bits)
            out[h] = out.get(h, 0) + 1
    return out


def test_language_scores_by_plain_loops(spark, tables):
    docs, _ = small(tables)
    model = langid.train(docs.where(features.fold("doc_id", 3) != 1), most=100)
    got = {r.doc_id: r for r in langid.identify(docs, most=100).collect()}
    for r in docs.where("text is not null and length(text) between 5 and 600").limit(25).collect():
        x = {k: n * float(model.idf[k]) for k, n in naive_counts(r.text.lower(), langid.ORDERS, langid.BITS).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / size * float(model.weights[k, c]) for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(model.labels))]
        p = [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (model.labels[best], pytest.approx(p[best], abs=1e-4))


def test_quality_scores_by_plain_loops(spark, tables):
    docs, labels = small(tables)
    known = labels.where(features.fold("doc_id", 3) != 1)
    model = quality.train(docs, known, most=100)
    got = {r.doc_id: r.score for r in quality.score(docs, labels, most=100).collect()}
    for r in docs.where("text is not null and length(text) between 5 and 600").limit(25).collect():
        held = naive_counts(quality.marked(r.text), quality.ORDERS, quality.BITS)
        size = math.sqrt(sum(float(model.ratio[k]) ** 2 for k in held))
        margin = sum(float(model.weights[k]) for k in held) / size + model.bias
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-4)


def test_toxicity_by_plain_loops(spark):
    """Features from plain counts of words and their prefixes over all texts, and scores from sums of their weights."""
    rng = random.Random(4)
    words = [f"w{rng.choice('abcdefgh')}{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" blastingly" if k % 4 == 0 else " blasted" if k % 44 == 1 else "") for k in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(800)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels.select("doc_id", "toxic"), most=50)
    raw = lambda t: tx.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 0, 1, toxicity.WORD)
    held = [{int(x) for _, h in toxicity.hashes(raw(t)) for x in h} for t in texts]
    n, m, prior = 200, 800, 0.25
    want = []
    for h in set().union(*held):
        a, b = sum(h in s for s in held[::4]), sum(h in s for s in held)
        share = (a + b + 1) / (n + m + 2)
        if a + b >= 5 and abs(a / n - b / m) / math.sqrt(share * (1 - share) * (1 / n + 1 / m)) >= 5 and prior * a / n >= 0.5 * b / m:
            want.append(h)
    assert sorted(int(w) for w in model.words) == sorted(want) and want
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, folds=10**9, out=1, most=50).collect()}
    weight = dict(zip((int(w) for w in model.words), model.weights, strict=True))
    for k in range(0, 800, 40):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(weight.get(h, 0.0) for h in held[k]) + model.bias))), abs=1e-9)


def test_samples_of_repeated_ids_stay_bounded(spark):
    """300 rows of 3 ids are 3 training rows; a doc_id has its smallest label and text."""
    rows = spark.createDataFrame([(k % 3, k % 2, f"t{k:03d}") for k in range(300)], "doc_id long, y int, text string")
    chosen = features.sample(rows, "y", 100)
    assert sorted(tuple(r) for r in chosen.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sorted(tuple(r) for r in features.sampled_texts(rows.select("doc_id", "text"), chosen).collect()) == [(0, 0, "t000"), (1, 0, "t001"), (2, 0, "t002")]
    assert sorted(tuple(r) for r in features.sampled_texts(rows.withColumnRenamed("y", "label"), chosen).collect()) == [(0, 0, "t000"), (1, 0, "t004"), (2, 0, "t002")]


def test_ftrl_by_plain_loops():
    """Per-coordinate updates written out."""
    rng = np.random.default_rng(3)
    rows = [(rng.choice(6, 3, replace=False), rng.random(3)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    w, b = langid.ftrl(rows, y, 3, 6, epochs=2, alpha=0.7, beta=0.5, l1=0.1, l2=0.2, seed=1)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]
    solve = lambda i, c: 0.0 if abs(z[i][c]) <= 0.1 else (math.copysign(0.1, z[i][c]) - z[i][c]) / ((0.5 + math.sqrt(n[i][c])) / 0.7 + 0.2)
    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation(40):
            x = [*zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True), (6, 1.0)]
            now = {(i, c): solve(i, c) for i, _ in x for c in range(3)}
            s = [sum(v * now[i, c] for i, v in x) for c in range(3)]
            p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
            for i, v in x:
                for c in range(3):
                    g = (p[c] - (y[k] == c)) * v
                    step = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / 0.7
                    z[i][c] += g - step * now[i, c]
                    n[i][c] += g * g
    assert np.allclose(w, [[solve(i, c) for c in range(3)] for i in range(6)]) and np.allclose(b, [solve(6, c) for c in range(3)])


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [(np.array([int(k), *rng.integers(2, 200, 5)]), np.full(6, 0.4)) for k in y]
    w, b = langid.ftrl(rows, y, 2, 200, l1=0.5)
    assert (w == 0).mean() > 0.4 and w[0, 0] > 0 > w[1, 0]
    logits = rng.standard_normal((500, 3))
    p = langid.softmax(logits / 2)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert 1.4 < langid.temperature(logits, labels) < 3


def test_hinge_separates_and_platt_is_monotone():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    rows = [(np.array([int(k), 2 + int(rng.integers(0, 50))]), np.array([0.7, 0.7])) for k in y]
    w, bias = quality.hinge(rows, y, 60)
    margin = np.array([x @ w[at] + bias for at, x in rows])
    assert ((margin > 0) == (y == 1)).all()
    slope, _ = quality.platt(margin, y)
    assert slope > 0


def test_nnpu_recovers_the_prior():
    rng = np.random.default_rng(2)
    positive = [np.array([0]) for _ in range(300)]
    unlabelled = [np.array([0]) if rng.random() < 0.2 else np.array([1 + int(rng.integers(0, 5))]) for _ in range(2000)]
    w, bias = toxicity.nnpu(positive, unlabelled, 6, 0.2)
    assert w[0] + bias > 0 and (w[1:] + bias < 0).all()


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = features.sample(df, "y", 100).collect()
    b = features.sample(df.repartition(7), "y", 100).collect()
    assert sorted(a) == sorted(b) and {r.label: sum(x.label == r.label for x in a) for r in a} == {0: 100, 1: 100}
