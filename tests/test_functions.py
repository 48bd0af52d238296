"""Scalar functions and matching strategies on stated values."""

import pytest
from pyspark.sql import functions as F

from assay.functions import scalar as fn
from assay.operators import matching as m


def one(spark, column, **values):
    df = spark.range(1).select(*(v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [("```json\n{}\n```", "{}"), ("```\n[1]\n```", "[1]"), ("  x\n", "x"), ("{}", "{}"), (None, None), ("```json {} ```", "{}"), ("", "")],
)
def test_strip_markdown(spark, text, want):
    assert one(spark, fn.strip_markdown("t"), t=F.lit(text).cast("string")) == want


@pytest.mark.parametrize(("x", "want"), [(0.1234565, 0.123457), (-0.1234565, -0.123456), (1.0, 1.0), (2 / 3, 0.666667)])
def test_r6(spark, x, want):
    assert one(spark, fn.r6("x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("", 1), ("   ", 0), ("a b ", 2), (" a b", 3), ("a\tb\nc", 3)])
def test_word_count(spark, x, want):
    assert one(spark, fn.word_count("x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("1.5", 1.0), ("-0.5", 0.0), ("0.25", 0.25), ("abc", None), ("NaN", None)])
def test_clamp(spark, x, want):
    assert one(spark, fn.clamp01("x"), x=x) == want


def test_texts(spark):
    assert one(spark, fn.truncate("x", 10), x="abcdefghijkl") == "abcdefg..."
    assert one(spark, fn.truncate("x", 10), x="abcdefghij") == "abcdefghij"
    assert one(spark, fn.shorten("x", 3), x="abcd") == "abc..."
    assert one(spark, fn.escape_html("x"), x="<a href='x'>&\"</a>") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"
    assert [one(spark, fn.escape_csv("x"), x=v) for v in ("a", "a,b", 'say "x"', "=1+1", "-1", "@x", "a\nb")] == ["a", '"a,b"', '"say ""x"""', '"=1+1"', '"-1"', '"@x"', '"a\nb"']
    assert one(spark, fn.escape_markdown_cell("x"), x="a|b") == "a\\|b"
    assert one(spark, fn.normalize_text("x"), x="  A \n b  ") == "a b"
    assert [one(spark, fn.format_number("x"), x=v) for v in (3.0, 2.25)] == ["3", "2.3"]
    assert one(spark, fn.base_name("x"), x="a/b/c.tar.gz") == "c.tar"
    assert [one(spark, fn.says_yes("x"), x=v) for v in (" Yes, so", "no")] == [True, False]
    assert one(spark, fn.java_list("x"), x=F.array(F.lit("a"), F.lit("b"))) == "[a, b]"
    assert [one(spark, fn.pretty_json("x"), x=v) for v in ('{"a": 1}', "{x")] == ['{"a":1}', "{x"]
    assert [one(spark, fn.relevance_bucket("x"), x=v) for v in (0.7, 0.5, 0.1)] == ["high", "partial", "irrelevant"]
    assert [one(spark, fn.pass_rate_bucket("x"), x=v) for v in (0.49, 0.5, 0.8)] == ["low", "medium", "high"]


@pytest.mark.parametrize(("value", "want"), [({}, ""), ({"k": "v"}, "v"), ({"a": "1", "output": "o"}, "o"), ({"b": "2", "a": "1"}, '{"a":"1","b":"2"}')])
def test_format_value(spark, value, want):
    df = spark.createDataFrame([(value,)], "x map<string,string>")
    assert df.select(fn.format_value("x").alias("r")).first().r == want


def test_duration(spark):
    t = "timestamp'2024-01-01 00:00:00'"
    done = lambda s: F.expr(f"timestampadd(SECOND, {s}, {t})")
    assert [one(spark, fn.duration("a", "b"), a=F.expr(t), b=done(s)) for s in (42, 185)] == ["42s", "3m 5s"]
    assert one(spark, fn.duration("a", "b"), a=F.expr(t), b=F.lit(None).cast("timestamp")) == "—"


@pytest.mark.parametrize(
    ("strategy", "retrieved", "expected", "want"),
    [
        (m.by_equality(), ["a", "a", "b"], ["a", "c"], 2), (m.by_equality(), ["A"], ["a"], 0), (m.by_equality(), [None, "a"], [None], 1), (m.case_insensitive(), ["A", "b"], ["a"], 1),
        (m.by_containment(), ["The  CAT sat"], ["cat"], 1), (m.by_containment(False), ["The CAT"], ["cat"], 0), (m.by_containment(), ["", "x"], ["abc"], 1), (m.any_of(), ["a"], ["a"], 0), (m.all_of(), ["a"], ["b"], 1),
        (m.any_of(m.by_equality(), m.case_insensitive()), ["A", "z"], ["a"], 1), (m.all_of(m.by_containment(), m.case_insensitive()), ["ab", "A"], ["a"], 1),
        (m.by_identifier(lambda x: F.substring(x, 1, 1)), ["ax", "bx"], ["ay"], 1), (m.custom(lambda r, e: F.length(r) == F.length(e)), ["xx", "y"], ["ab"], 1), (m.by_equality(), [], ["a"], 0),
    ],
)
def test_matching(spark, strategy, retrieved, expected, want):
    df = spark.createDataFrame([(retrieved, expected)], "r array<string>, e array<string>")
    assert df.select(m.count_matches("r", "e", strategy).alias("n")).first().n == want


def test_fields(spark):
    t = "array<struct<subject:string,predicate:string,object:string>>"
    df = spark.createDataFrame([([("a", "is", "b"), ("c", "is", "d"), (None, "x", "y")], [("a", "is", "z"), (None, "q", "y")])], f"r {t}, e {t}")
    count = lambda s: df.select(m.count_matches("r", "e", s).alias("n")).first().n
    assert (count(m.by_field("subject")), count(m.by_fields("subject", "predicate")), count(m.by_fields("subject", "object"))) == (2, 1, 1)
