"""URL filters: host and path rules, and association rules mined from the URLs that they decide.

A URL is a basket of tokens. FP-growth finds token combinations that are frequent together with a label; their support and confidence are
then counted over all labelled URLs, and the rules that hold are matched through an inverted index from each rule's rarest token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, batches

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Host, path and verdict of the rules of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LABELS = ("allow", "block")
MARK = "="  # begins a label as an item of a basket; no token begins so
PARTS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``; A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, *AZ), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def ruling(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits; of rules of equal length the one with the longer host; null if none does.

    A rule is looked up by the last labels of the host and the first characters of the path, so the work for a URL depends on
    how many different depths and lengths the rules have.
    """
    keys = []
    for depth in sorted({len(h.split(".")) for h, _, _ in rules}):
        keys += [F.struct(F.substring_index(host, ".", -depth).alias("h"), F.substring(path, 1, n).alias("p")) for n in sorted({len(p) for _, p, _ in rules})]
    table = F.create_map(*(c for h, p, v in rules for c in (F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")), F.lit(v))))
    found = F.filter(F.array(*keys), lambda k: F.map_contains_key(table, k))
    best = F.try_element_at(F.reverse(F.array_sort(F.transform(found, lambda k: F.struct((F.length(k["h"]) + F.length(k["p"])).alias("n"), F.length(k["h"]).alias("m"), k.alias("k"))))), F.lit(1))["k"]
    return F.concat(best["h"], best["p"]), F.try_element_at(table, best)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a whole URL: host labels by depth from the right, path segments with numbers as 0, names of the query, and a fragment."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit(":"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("s:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, segments, names, fragment))


@dataclass(frozen=True)
class Association:
    """All of ``tokens`` in a URL speak for ``label``."""

    tokens: frozenset[str]
    label: str
    support: int
    confidence: float

    def order(self) -> tuple:
        """Surer rules first; then those of more support, of fewer tokens, and by their text."""
        return -self.confidence, -self.support, len(self.tokens), sorted(self.tokens), self.label


class Index:
    """Inverted index: each rule under the rarest of its tokens, so that a URL meets only rules that its tokens name."""

    def __init__(self, rules: list[Association], frequency: dict[str, int]):
        self.rules = sorted(rules, key=Association.order)
        self.under: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            self.under.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(k)

    def matches(self, found: set[str]) -> Iterator[int]:
        """Places of the rules whose tokens are all in ``found``."""
        for t in found:
            for k in self.under.get(t, ()):
                if self.rules[k].tokens <= found:
                    yield k

    def verdicts(self):
        """A function from a Column of tokens to (label, rule) of the first rule in order that matches; null if none does."""

        @F.pandas_udf("label string, mined string")
        def judge(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for column in it:
                best = [min(self.matches(set(x)), default=None) for x in column]
                yield pd.DataFrame({"label": [None if k is None else self.rules[k].label for k in best], "mined": [None if k is None else " ".join(sorted(self.rules[k].tokens)) for k in best]}, dtype=object)

        return judge

    def counting(self):
        """A mapInPandas function: how many URLs of each label each rule matches, summed over a batch."""

        def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                pairs = [(k, label) for x, label in zip(pdf["tokens"], pdf["label"], strict=True) for k in self.matches(set(x))]
                yield pd.DataFrame(pairs, columns=["rule", "label"]).astype({"rule": "int64"}).groupby(["rule", "label"]).size().rename("n").reset_index()

        return count


def mined(labelled: DataFrame, scratch: Scratch, support: float = 0.005, confidence: float = 0.9, vocabulary: int = 256, longest: int = 12, most: int = 50_000, rules: int = 2_000) -> Index:
    """Association rules from rows (tokens, label).

    Bounds of the fit: FP-growth runs on about ``most`` URLs told by hash, over the ``vocabulary`` tokens that differ most between the
    labels, the ``longest`` first of them in a URL; ``rules`` candidates are counted. Frequencies of tokens, and the support and
    confidence by which rules stay, are counted over all rows. A rule goes if one with a part of its tokens is as sure.
    """
    n = labelled.count()
    if not n:
        return Index([], {})
    least = max(2, int(support * n))
    seen = labelled.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == x).alias(x) for x in LABELS)).where(F.col("n") >= least)
    shares = labelled.agg(*(F.count_if(F.col("label") == x).alias(x) for x in LABELS)).first()
    expected = [shares[x] / n for x in LABELS]
    unlike = sum((F.pow(F.col(x) - F.col("n") * e, 2) / (F.col("n") * e) for x, e in zip(LABELS, expected, strict=True) if e), F.lit(0.0))
    words = [(r.token, r.n) for r in seen.orderBy(unlike.desc(), F.desc("n"), "token").limit(vocabulary).collect()]
    frequency = dict(words)
    if not words:
        return Index([], {})
    place = F.create_map(*(F.lit(c) for k, (w, _) in enumerate(words) for c in (w, k)))
    ranked = F.array_sort(F.filter(F.transform("tokens", lambda t: F.struct(F.try_element_at(place, t).alias("at"), t.alias("t"))), lambda x: x["at"].isNotNull()))
    chosen = F.transform(F.slice(ranked, 1, longest), lambda x: x["t"])
    sample = labelled.where(F.pmod(F.xxhash64("place", "tokens"), F.lit(PARTS)) < F.lit(max(1, PARTS * most // n)))
    baskets = scratch.save(sample.select(F.concat(chosen, F.array(F.concat(F.lit(MARK), F.col("label")))).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    sets = scratch.save(sets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    label = F.filter("items", lambda x: x.startswith(MARK))
    told = sets.where((F.size(label) == 1) & (F.size("items") > 1)).select(F.filter("items", lambda x: ~x.startswith(MARK)).alias("items"), F.substring(label[0], 2, 99).alias("label"), F.col("freq").alias("both"))
    told = told.join(sets, "items").where(F.col("both") >= confidence * F.col("freq"))
    told = told.orderBy((F.col("both") / F.col("freq")).desc(), F.size("items"), F.desc("both"), "items", "label").limit(rules).collect()
    candidates = Index([Association(frozenset(r["items"]), r.label, r.both, r.both / r.freq) for r in told], frequency)
    if not told:
        return candidates
    held: dict[int, dict[str, int]] = {}
    for r in labelled.select("tokens", "label").mapInPandas(candidates.counting(), "rule long, label string, n long").groupBy("rule", "label").agg(F.sum("n").alias("n")).collect():  # two rows a candidate at most
        held.setdefault(r.rule, {})[r.label] = r.n
    sure = []
    for k, counts in held.items():
        r, both = candidates.rules[k], counts.get(candidates.rules[k].label, 0)
        if both >= least and both >= confidence * sum(counts.values()):
            sure.append(Association(r.tokens, r.label, both, both / sum(counts.values())))
    sure.sort(key=lambda r: (len(r.tokens), r.order()))
    kept: list[Association] = []
    for r in sure:
        if not any(s.label == r.label and s.confidence >= r.confidence and s.tokens <= r.tokens for s in kept):
            kept.append(r)
    return Index(kept, frequency)


def judged(pages: DataFrame, rules=RULES, default: str = "allow", **bounds) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): allow or block for every URL, by its rule or else by mined associations.

    ``mined`` names the tokens of the association that decided; where none fits, the verdict is ``default``. The URLs that a rule decides, with
    its verdict, are what associations are mined from (see :func:`mined` for ``bounds``).

    A null URL, or one without ``://``, has an empty host and path. Rows that repeat stay, each judged alike; a null page_id is kept; other columns
    are left aside. Very long URLs count whole. Without labelled URLs there are no associations. Empty table: no rows.
    """
    spark = pages.sparkSession
    batches(spark)
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruling(F.col("host"), F.col("path"), list(rules))
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    basket = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = scratch.save(rows.where("verdict is not null").select(basket.alias("tokens"), F.col("verdict").alias("label"), F.xxhash64("page_id").alias("place")), "labelled")
    index = mined(labelled, scratch, **bounds)
    told = index.verdicts()(F.when(F.col("verdict").isNull(), basket).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("_told", told)
    return scratch.result(out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_told.label", F.lit(default)).alias("verdict"), F.col("_told.mined").alias("mined")))
