"""Vector codes against plain loops, and the VA-file's bounds."""

import hashlib
import math

import numpy as np
import pytest

from assay.llm import codes
from assay.llm.codes import Cells, compress

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long, z int"


def brute(rows, parts=16, entries=64, rounds=2):
    """One row at a time, one entry at a time."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda p, x: min(range(len(books[p])), key=lambda k: (far(books[p][k], x), k))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(pick(p, c[p]), []).append(c[p])
            for k, xs in held.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, lab), c in zip(kept, cut, strict=True):
        at = [pick(p, c[p]) for p in range(parts)]
        error = sum(far(books[p][k], c[p]) for p, k in enumerate(at))
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for k in at), error, lab))
    return sorted(((i, code, error, sums[lab], digest) for i, code, error, lab in out), key=repr)


def got(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in compress(frame, **kw).collect()), key=repr)


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(k * 7 % 401, rng.standard_normal(64).tolist(), int(rng.integers(4))) for k in range(200)]
    assert got(spark, rows) == brute(rows)


def test_ties_repeats_nulls_and_others(spark):
    rng = np.random.default_rng(4)
    grid = [(k, rng.integers(-2, 3, 32).astype(float).tolist(), None if k % 5 == 0 else k % 2) for k in range(90)]
    odd = [
        (None, [0.5] * 32, 1), (None, [0.25] * 32, None), (3, grid[3][1], 0), (3, [1.0] * 32, 7), (-5, [-1.001] * 32, 1),
        (900, None, 1), (901, [None] + [0.0] * 31, 1), (902, [math.nan] + [0.0] * 31, 1), (903, [math.inf] * 32, None), (904, [-math.inf] + [0.0] * 31, 2), (905, [-0.0] * 32, 2),
    ]
    assert got(spark, grid + odd) == brute(grid + odd)


def test_few_vectors_none_and_long_parts(spark):
    rng = np.random.default_rng(5)
    few = [(k, rng.standard_normal(48).tolist(), 1) for k in range(3)]
    assert got(spark, few) == brute(few)
    assert got(spark, [(1, None, 2)]) == got(spark, []) == []
    long = [(k, (rng.standard_normal(512) * 100).tolist(), k % 2) for k in range(80)]
    assert got(spark, long) == brute(long)


def test_what_cannot_be_cut_is_an_error(spark):
    with pytest.raises(ValueError, match="components"):
        got(spark, [(1, [0.0] * 64, 1), (2, [0.0] * 32, 1)])
    with pytest.raises(Exception, match="a component is beyond"):
        got(spark, [(1, [1e9] + [0.0] * 63, 1)])


def test_many_labels_are_joined_in_parts(spark):
    rows = spark.createDataFrame([(k, "0", k, k % 7 or None) for k in range(500)], "vec_id long, code string, error long, label int")
    sums = rows.groupBy("label").agg({"error": "sum"}).withColumnRenamed("sum(error)", "label_error")
    few, many = (sorted(codes._joined(rows, sums, few=n).select("vec_id", "label_error").collect()) for n in (100, 0))
    assert few == many and len(few) == 500


def test_bounds_hold_and_leave_few(spark):
    rng = np.random.default_rng(6)
    book, x = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (500, 4))
    cells = Cells(book)
    lower, upper = cells.bounds(x)
    exact = np.square(x[:, None, :] - book[None]).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.35
    index, distance = cells.nearest(x)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
