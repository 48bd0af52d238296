"""Containment of texts against plain comparisons, by each of its plans."""

import random

import pytest

from assay.operators import containment as c

SCHEMA = "id long, text string"


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    outer = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 900), (5, "a b"), (5, "a b")]
    inner = [(k, (t := outer[rng.randrange(60)][1])[(i := rng.randrange(len(t) + 1)) : i + rng.randint(0, 60)]) for k in range(120)]
    return inner + [(200, "a"), (201, ""), (202, None), (203, "zz " * 9 + "q"), (204, "x" * 30), (205, "x" * 901), (206, "x" * 8), (7, inner[7][1]), (207, outer[3][1]), (208, "\x00a"), (209, "é")], outer


def want(inner, outer):
    return sorted((a, b) for a, s in inner for b, t in outer if s and t and s in t)


@pytest.mark.parametrize("plan", ["inner", "outer", "both"])
def test_contained(spark, plan, monkeypatch):
    monkeypatch.setattr(c, "STEP", 100)
    monkeypatch.setattr(c, "LISTED", 3)
    inner, outer = corpus()
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (inner, outer)]
    sizes = iter({"inner": [0], "outer": [9, 0], "both": [9, 9]}[plan])
    monkeypatch.setattr(c, "_size", lambda df: (1, next(sizes)))
    got = sorted(map(tuple, c.contained(*frames, bound=5).collect()))
    assert got == want(inner, outer) and len(got) > 100


@pytest.mark.parametrize("bound", [c.BOUND, 0])
def test_either(spark, bound):
    a, b = corpus(7)
    got = sorted(map(tuple, c.either(*(spark.createDataFrame(x, SCHEMA) for x in (a, b)), bound=bound).collect()))
    assert got == sorted((i, j) for i, s in a for j, t in b if s and t and (s in t or t in s))


def test_nothing_to_find(spark):
    none, some = (spark.createDataFrame(x, SCHEMA) for x in ([(1, None), (2, "")], [(1, "abc")]))
    for bound in (c.BOUND, 0):
        assert c.contained(none, some, bound).collect() == c.contained(some, none, bound).collect() == c.either(none, some, bound).collect() == []
        assert c.contained(some, spark.createDataFrame([(9, "x")], SCHEMA), bound).collect() == []
