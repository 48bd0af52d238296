"""Typed values: equality by type, matching, and datasets that keep them through Parquet."""

import json

import pytest
from pyspark.sql import functions as F

from assay.functions import typed
from assay.operators import evaluators as ev
from assay.operators import matching as m
from assay.sources import datasets as ds

VALUES = ["1", "1.0", '"1"', "2.5", "true", '"true"', "null", "[1]", "[1.0]", '["1"]', '[1, "a"]', '[1.0, "a"]', "[[1]]", "{}", '{"a": 1}', '{"a": "1"}', '{"a": 1.0}', "12345678901234567890123", '""', "[]"]


def test_equal_only_in_type_and_value(spark):
    a = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "i int, t string")
    b = a.select(F.col("i").alias("j"), F.col("t").alias("u"))
    pairs = a.crossJoin(b).where(typed.same(typed.parsed("t"), typed.parsed("u"))).select("i", "j").collect()
    assert sorted(map(tuple, pairs)) == [(k, k) for k in range(len(VALUES))]
    one = spark.createDataFrame([('{"b": [1, 2], "a": "x"}', '{"a":"x","b":[1,2]}', None)], "t string, u string, n string")
    got = one.select(typed.same(typed.parsed("t"), typed.parsed("u")), typed.same(typed.parsed("t"), typed.parsed("n")), typed.same(typed.parsed("n"), typed.parsed("n"))).first()
    assert tuple(got) == (True, False, True)


def test_texts_and_items(spark):
    rows = spark.createDataFrame([(v,) for v in ('["a", 1, null]', '"a b"', "1", "null", None)], "t string").select(typed.parsed("t").alias("v"))
    assert [r[0] for r in rows.select(typed.text("v")).collect()] == ["[a, 1, null]", "a b", "1", None, None]
    assert [r[0] for r in rows.select(F.size(typed.items("v"))).collect()] == [3, 1, 1, 1, None]
    odd = spark.createDataFrame([(json.dumps({"a b": 1, "x.y": 2, "q": 3}),)], "t string")
    assert tuple(odd.select(*(typed.text(typed.field(typed.parsed("t"), k)) for k in ("a b", "x.y", "z"))).first()) == ("1", "2", None)


def test_matching_by_type(spark):
    rows = spark.createDataFrame([('[1, "1", 1.0, 1, null]', "[1, 2]", '[{"id": 1, "n": "x"}, {"id": "1"}, {"n": 1}, "s"]', '[{"id": 1}, {"other": 2}, "s"]')], "r string, e string, ro string, eo string")
    lists = rows.select(*(typed.items(typed.parsed(c)).alias(c) for c in rows.columns))
    assert lists.select(m.count_matches("r", "e", m.by_typed_equality())).first()[0] == 2  # the bag's two 1s
    assert lists.select(m.count_matches("ro", "eo", m.by_typed_field("id"))).first()[0] == 3  # 1, the missing one, and the text
    assert lists.select(ev.precision("r", "e", m.by_typed_equality())["score"]).first()[0] == 0.4


def test_datasets_keep_types_through_parquet(spark, tmp_path):
    text = json.dumps({"examples": [{"input": 1, "expectedOutput": [1, [2.5, "x"]]}, {"inputs": {"input": "1", "k": {"z": True}}, "input": "ignored", "metadata": {"m": None}}, {"inputs": {}, "input": 1.0}, {}]})
    made = ds.typed_examples(spark.createDataFrame([(text,)], "value string"))
    made.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("example_idx")
    got = [tuple(r) for r in rows.select("example_idx", *(F.to_json(c) for c in ("inputs", "expected_outputs", "metadata"))).collect()]
    assert got == [(0, '{"input":1}', '{"output":[1,[2.5,"x"]]}', "{}"), (1, '{"input":"1","k":{"z":true}}', "{}", '{"m":null}'), (2, '{"input":1}', "{}", "{}"), (3, "{}", "{}", "{}")]
    kinds = [r[0] for r in rows.select(typed.kind(typed.field("inputs", "input"))).collect()]
    assert kinds == ["BIGINT", "STRING", "DOUBLE", None]
    for bad, why in (("{x", "Failed"), ("{}", "examples")):
        with pytest.raises(Exception, match=why):
            ds.typed_examples(spark.createDataFrame([(bad,)], "value string")).collect()
