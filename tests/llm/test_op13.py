"""Source divergence against plain loops, and its tournament."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from assay.llm import divergence
from assay.llm.divergence import audit, partner

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, seat int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, top=50):
    """Counts in dictionaries, every pair and term on its own."""
    groups, df = {}, {}
    for _, text, lang, source in docs:
        lang, words = lang or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        groups.setdefault((lang, source or ""), Counter()).update(words)
        df.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, seen in df.items():
        kept = [t for t, n in seen.items() if n >= least]
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, rows, n in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows[:n], 1)]
    return sorted(out)


def got(spark, docs, **kw):
    return sorted(tuple(r) for r in audit(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA), **kw).collect())


def made(seed, docs, langs, sources, words):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(langs), rng.choice(sources)) for k in range(docs)]


def test_equals_plain_loops_over_seats_and_chunks(spark):
    words = [c + d for c in "aBcÉüñ" for d in ("", "x", "Yz", "ß", "7q", "'s", "日本")]
    docs = made(1, 600, ("en", "fr", None), [f"s{k}" for k in range(11)] + [None], words)
    assert got(spark, docs, least=10, top=5, block=2, width=8) == brute(docs, 10, 5)
    assert got(spark, docs) == brute(docs)


def test_edges(spark):
    few = [(1, "alone here", "xx", "a"), (2, None, "xx", "b"), (3, "", "xx", None), (4, "one source", "yy", "a"), (None, "42 !? _", None, None)]
    assert got(spark, few) == brute(few)  # no language keeps a term: pairs at 0
    assert len(got(spark, few)) == 6
    same = [(7, "Same words", "en", "a")] * 40 + [(7, "same other", "en", "b")] * 40 + [(8, "", "en", "c")]
    assert got(spark, same) == brute(same)  # repeated rows count, ties go by bytes, a group without terms
    assert got(spark, []) == []


def test_long_rows_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    long = "w" * 500 + " " + " ".join(f"Wort{'abc'[k % 3]}" for k in range(900)) + " é" * 300
    docs = [(k, long if k % 2 else "worta é", "de", f"s{k % 3}") for k in range(60)]
    raw = np.frombuffer(long.encode(), dtype=np.uint8)
    cuts = [b.tolist() for _, b in divergence.pieces(raw, np.array([0, len(raw)]), 64)]
    assert len(cuts) > 50 and cuts[0][1] >= 500 and all(a[-1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and cuts[-1][-1] == len(raw)
    assert all(not divergence.TERM[divergence.LOWER[raw[c[0] - 1]]] or not divergence.TERM[divergence.LOWER[raw[c[0]]]] for c in cuts[1:])
    assert got(spark, docs) == brute(docs)


def test_every_two_seats_meet_once(spark):
    for seats in (2, 4, 10):
        met = []
        for turn in range(seats - 1):
            rows = spark.range(seats).select(F.col("id").cast("int").alias("s")).select("s", partner(F.col("s"), turn, seats).alias("t")).collect()
            assert {r.s for r in rows} == {r.t for r in rows} == set(range(seats))  # each has one partner
            met += [(r.t, r.s) for r in rows if r.s > r.t]
        assert sorted(met) == list(combinations(range(seats), 2))


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 9_007_199_254_740_993, 123_456_789_012_345_678, 7
    rows = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert rows.select(divergence._share("n", F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)
