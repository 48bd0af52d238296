"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from assay.llm import neighbours
from assay.llm.neighbours import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least):
    ids = range(len(rows))
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    x = [np.array(np.array(v, dtype=np.float32), dtype=np.float64) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    root, n = list(ids), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= least:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i in ids:
        best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], best[find(i)], rows[i][0] == best[find(i)]) for i in ids)


def got(spark, rows):
    return sorted(tuple(r) for r in near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())


def test_groups_pairs_and_chains(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in range(3):
        centre = rng.standard_normal(24)
        rows += [(len(rows) + k, (centre + 0.12 * rng.standard_normal(24)).tolist(), label) for k in range(60)]  # more links than a first list holds
        for _ in range(15):
            v = rng.standard_normal(24)
            rows += [(len(rows), v.tolist(), label), (len(rows) + 1, (v + 0.1 * rng.standard_normal(24)).tolist(), label)]
        rows += [(len(rows) + k, rng.standard_normal(24).tolist(), label) for k in range(150)]
        a, b = rng.standard_normal(24), rng.standard_normal(24)
        rows += [(len(rows) + k, (a * np.cos(0.3 * k) + b * np.sin(0.3 * k)).tolist(), label) for k in range(5)]
    assert got(spark, rows) == brute(rows, 0.93)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 1.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (12, v, 1), (12, v, 1)]
    assert got(spark, rows) == brute(rows, 0.93)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_is_judged_by_vector():
    """A hot group's links are all found, those of half the pairs are not: a share a vector, and few links apart from many."""
    hot, pairs = [(300, 300)] * 30, [(1, k % 2) for k in range(10)]
    assert neighbours._recall(hot + pairs) == 0.5
    assert neighbours._recall([]) == neighbours._recall([(0, 0)]) == 1.0


def planted(seed=5, n=700, pairs=75):
    """Two labels of far vectors, each with close pairs."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        rows += [(len(rows) + k, rng.standard_normal(64).tolist(), label) for k in range(n)]
        for _ in range(pairs):
            v = rng.standard_normal(64)
            rows += [(len(rows), v.tolist(), label), (len(rows) + 1, (v + 0.25 * rng.standard_normal(64)).tolist(), label)]
    return rows


def test_descent_finds_what_the_random_start_lacks(spark):
    rows, progress = planted(), []
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = sorted(tuple(r) for r in near_duplicates(frame, progress=progress).collect())
    want = brute(rows, 0.93)
    links = sum(r[1] for r in want)
    assert all(a[1] <= b[1] and a[2] >= b[2] for a, b in zip(out, want, strict=True))  # no link that is none
    assert sum(r[1] for r in out) >= 0.99 * links and links == 4 * 75
    assert progress[0][1] < 0.5 * links and progress[-1][1] >= 0.99 * links  # directed edges after the first round and the last


def test_short_recall_goes_on_or_raises(spark, monkeypatch):
    rows = planted(n=40, pairs=10)
    start = neighbours._random
    monkeypatch.setattr(neighbours, "_random", lambda nodes, seed, least: start(nodes, seed, least).where(str(seed >= 2)))
    assert got(spark, rows) == brute(rows, 0.93)
    monkeypatch.setattr(neighbours, "_random", lambda nodes, seed, least: start(nodes, seed, least).where("false"))
    monkeypatch.setattr(neighbours, "TRIES", 2)
    with pytest.raises(RuntimeError, match="recall"):
        got(spark, rows)


def test_links_that_no_neighbour_knows_of(spark, monkeypatch):
    """Short lists among many far vectors settle where no neighbour leads to a link, as long ones do among more vectors: projections lead there."""
    for name, value in {"LIST": 4, "SAMPLE": 3, "GATHER": 8, "TRIES": 2}.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = planted(n=1500, pairs=60)
    progress = []
    out = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), progress=progress).collect())
    want = brute(rows, 0.93)
    assert sum(r[1] for r in want) == 240 and sum(r[1] for r in out) >= 237
    assert all(a[1] <= b[1] and a[2] >= b[2] for a, b in zip(out, want, strict=True))
    assert progress[0][1] < 0.1 * 240


def test_rounds_end_when_no_links_are_gained(spark):
    """Lists of far vectors still change when the last links have long been found."""
    rows, progress = [(k, v.tolist(), 0) for k, v in enumerate(np.random.default_rng(4).standard_normal((3000, 48)))], []
    out = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), progress=progress)
    assert out.where("n_links <> 0 or not kept").count() == 0 and out.count() == 3000
    assert len(progress) == 3


def test_hot_kinds_meet_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 50)
    rows = planted(n=60, pairs=20) + [(9000, [1.0] * 64, 7), (9001, [1.0] * 63 + [1.1], 7)]
    assert got(spark, rows) == brute(rows, 0.93)


def test_blocks_of_a_large_component(spark, monkeypatch):
    """Links counted inside blocks, by bounds, and between blocks, with copies; lists shorter than the links."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "LONGEST", 20)
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
    rows = [(k, (a * np.cos(t) + b * np.sin(t) + 0.01 * rng.standard_normal(24)).tolist(), 0) for k, t in enumerate(rng.random(300) * 1.2)]
    rows += [(300 + k, rows[k][1], 0) for k in range(30)]
    assert got(spark, rows) == brute(rows, 0.93)


def test_huge_and_tiny_numbers(spark):
    v = np.array([1.0, 2.0, 3.0, -1.0])
    rows = [(1, (v * 2.0**100).tolist(), 1), (2, (v * 2.0**-100).tolist(), 1), (3, (-v).tolist(), 1)]
    assert got(spark, rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
