"""URL verdicts: rules against plain loops, and mined associations."""

import random
import re

from assay.llm.urls import RULES, Association, Index, judged, mined, tokens
from assay.llm.scratch import Scratch
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, host string, verdict int, tokens string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(AZ), re.match(r"[^?#]*", rest[len(host) :]).group()


def ruled(url, rules=RULES):
    host, path = parsed(url)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def got(spark, rows, **kw):
    out = judged(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), **kw)
    assert out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


ODD = [
    None, "", "no scheme", "://", "://com/", "http://com", "http://COM/", "http://a.com/x://net/fr/", "http://xcom/", "http://.com/", "http://a.com?x=1", "http://a.com#/en/", "http://example.com/en", "http://example.com/en/",
    "http://www.example.com/en/1", "http://x.www.EXAMPLE.com/en/?q", "http://wwwexample.com/en/", "http://wwx.example.com/EN/", "https://net/es/", "ftp://a.b.net/fr/", "http://a.net:80/fr/", "http://u@a.net/fr/#?", "http://a.net//fr/",
    "http://é.com/ü", "http://İ.NET/es/x", "HTTP://A.com./", "http://a.com/\n/en/", "http://ex.com/" + "a/" * 20000, "http://" + "s." * 5000 + "net/fr/" + "b" * 20000,
]


def test_rules_of_odd_urls(spark):
    rows = [(k, u) for k, u in enumerate(ODD)] + [(None, "http://a.com/"), (5, None), (5, None)]
    out = got(spark, rows)
    want = sorted(((i, *parsed(u), *ruled(u)) for i, u in rows), key=repr)
    assert [r[:4] for r in out] == [w[:4] for w in want]
    for r, w in zip(out, want, strict=True):
        assert r[4] == w[4] if w[3] else r[4] in ("allow", "block")
    assert got(spark, []) == []


def test_random_rules_take_the_longest(spark):
    rng = random.Random(1)
    part = lambda: rng.choice("abc")
    rules = tuple({(h, p): (h, p, rng.choice(("allow", "block"))) for h, p in (((".".join(part() for _ in range(rng.randint(1, 3)))), "/" + part() * rng.randint(0, 2)) for _ in range(25))}.values())
    rows = [(k, f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{part() * rng.randint(0, 3)}") for k in range(300)]
    assert [(r[0], r[3]) for r in got(spark, rows, rules=rules)] == sorted(((i, ruled(u, rules)[0]) for i, u in rows), key=repr)


def test_associations_decide_the_rest(spark):
    """Spanish and French pages under net are blocked by rule; elsewhere what was learnt there counts, and com's allowance."""
    rng = random.Random(2)
    rows = [(k, f"http://{rng.choice(('www', 'm', 'blog'))}.h{k}.{rng.choice(('net', 'com'))}/{rng.choice(('es', 'fr', 'de'))}/{k}") for k in range(600)]
    rows += [(1000, "http://a.org/other/7"), (1001, "http://b.net/pl/9"), (1002, "http://c.com"), (1003, None)]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[1000][4:] == ("allow", None) and out[1003][4:] == ("allow", None)  # nothing learnt: the default
    assert out[1001][4:] == ("block", "h1:net")
    assert out[1002][4:] == ("allow", "h1:com")
    free = [r for r in out.values() if r[2].startswith("/de/") and r[1].endswith(".net")]
    assert free and {r[4] for r in free} == {"block"} and all(r[3] is None and "h1:net" in r[5].split() for r in free)


def test_mined_rules_hold_as_counted(spark):
    """Support and confidence against plain counts; every kept rule is found by the index in each URL that holds its tokens."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(1500):
        basket = sorted(set(rng.sample(words, 4)))
        bad = {"w1", "w2"} <= set(basket) or "w7" in basket
        rows.append((basket, "block" if bad else "allow", k))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string, place long")
    index = mined(frame, Scratch(spark, "mined"), support=0.01)
    found = {r.tokens: r for r in index.rules}
    assert found[frozenset({"w7"})].label == "block" and found[frozenset({"w1", "w2"})].confidence == 1.0
    assert not any(frozenset({"w7"}) < t for t in found)  # a part of its tokens is as sure
    for r in index.rules:
        held = [label for basket, label, _ in rows if r.tokens <= set(basket)]
        assert r.support == held.count(r.label) >= 15 and r.confidence == held.count(r.label) / len(held) >= 0.9
    for basket, _, _ in rows[:200]:
        assert set(index.matches(set(basket))) == {k for k, r in enumerate(index.rules) if r.tokens <= set(basket)}
    small = mined(frame, Scratch(spark, "mined"), support=0.01, most=400)  # fitted on a part, counted over all
    assert {t: (r.support, r.confidence) for t, r in found.items()}.items() >= {r.tokens: (r.support, r.confidence) for r in small.rules if r.tokens in found}.items()


def test_tokens_read_the_whole_url(spark):
    url = "https://M.a.Example.net/fr/25/Page7.html?utm=1&&b#top"
    host, path = parsed(url)
    row = spark.createDataFrame([(url, host, path)], "u string, h string, p string").select(tokens(F.col("u"), F.col("h"), F.col("p")).alias("t")).first().t
    assert row == ["h1:net", "h2:example", "h3:a", "h4:m", "s:fr", "s:0", "s:Page0.html", "q:utm", "q:b", "f:"]


def test_index_order_and_empty():
    a, b = Association(frozenset({"x"}), "allow", 5, 0.9), Association(frozenset({"x", "y"}), "block", 4, 1.0)
    index = Index([a, b], {"x": 9, "y": 4})
    assert [index.rules[k] for k in sorted(index.matches({"x", "y", "z"}))] == [b, a] and index.under == {"y": [0], "x": [1]}
    assert list(Index([], {}).matches({"x"})) == []
