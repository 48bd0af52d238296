"""JSON datasets by ranges against the whole file, and odd texts."""

import json
import random

import pytest

from assay.sources import datasets as ds
from assay.sources.json_ranges import members


def rows(d):
    return [(r.example_idx, r.inputs, r.expected_outputs, r.metadata) for r in d]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for c in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.{c}")


def made(rng, n):
    odd = ['a"b', "\\", '\\"', "}{][", '"}', "é}日", "x" * 700, "", "\n\t", '{"k": [1, {"z": "}"}]}', "\\\\\\"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 3)))
    out = []
    for k in range(n):
        e = {"input": f"{k} {text()}", "expectedOutput": text()} if rng.random() < 0.5 else {"inputs": {"input": text(), "k}": text()}, "expectedOutputs": {"output": text()}, "metadata": {text() + "m": text()}}
        out.append(e)
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_equals_the_whole_file(spark, tmp_path, small_ranges, indent):
    rng = random.Random(indent or 7)
    data = {"other": [{"input": "not this"}, [1]], "meta}": {"examples": [{"input": "nor this"}]}, "name": 'n "}"', "examples": made(rng, 150), "more": [{"input": "x"}, {"a": [{}]}], "description": "d\\"}
    path = str(tmp_path / "x.json")
    open(path, "w").write(json.dumps(data, indent=indent, ensure_ascii=indent is None) + ("\n \n" if indent else ""))
    whole, cut = ds.from_json(spark, path), ds.from_json(spark, path, whole=0)
    assert cut.frame.rdd.getNumPartitions() > 20
    assert (cut.name, cut.description) == (whole.name, whole.description) == ('n "}"', "d\\")
    got = rows(cut)
    assert got == rows(whole) and len(got) == 150


def test_members_over_many_ranges(spark, tmp_path, small_ranges):
    data = {"examples": [{"input": "}" * 2000}, {"input": '"' * 1000, "metadata": {"a": "[" * 900}}, {"input": "z"}]}
    path = str(tmp_path / "x.json")
    open(path, "w").write(json.dumps(data))
    assert [(i, x["input"]) for i, x, _, _ in rows(ds.from_json(spark, path, whole=0))] == [(k, e["input"]) for k, e in enumerate(data["examples"])]


def test_what_is_no_dataset(spark, tmp_path, small_ranges):
    for text, why in (("{}", "examples"), ('{"examples": null}', "examples"), ('{"examples": {"a": [{}]}}', "examples"), ("[1]", "Failed"), ("{x", "Failed"), ("", "Failed"), ('{"examples": [{"a": 1}', "Failed")):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(Exception, match=why):
            ds.from_json(spark, str(tmp_path / "b.json"), whole=-1).size()
    (tmp_path / "c.json").write_text('{"examples": [{"input": "a"}, {"input": tru}]}')
    with pytest.raises(Exception, match="Failed to parse"):
        ds.from_json(spark, str(tmp_path / "c.json"), whole=-1).frame.collect()
    (tmp_path / "e.json").write_text('{"examples": [ ], "name": 5}')
    empty = ds.from_json(spark, str(tmp_path / "e.json"), whole=-1)
    assert empty.size() == 0 and empty.name == "unnamed"
    head, found = members(spark, str(tmp_path / "e.json"), "none")
    assert head == {"examples": [], "name": 5} and found.collect() == []


def test_objects_of_the_root_are_kept_whole(spark, tmp_path, small_ranges):
    """Named objects before, after and across ranges keep what they hold; others do not; of equal names the last counts."""
    deep = {"a": ['}"', {"b": [{}, "{"]}], "n": 1.5, "t": "\\" + "]" * 700}
    text = json.dumps({"first": deep, "no": {"x": 1}, "items": [{"input": "}{" * 300}, {"input": "b", "first": {"z": 1}}], "empty": {}, "list": [1, {}], "last": {"k": deep}, "end": None}, indent=2)
    (tmp_path / "x.json").write_text(text)
    head, found = members(spark, str(tmp_path / "x.json"), "items", whole=("first", "empty", "list", "last", "end", "absent"))
    assert head == {"first": deep, "no": {}, "items": [], "empty": {}, "list": [], "last": {"k": deep}, "end": None}
    assert [json.loads(r.text)["input"] for r in found.orderBy("nth").collect()] == ["}{" * 300, "b"]
    (tmp_path / "y.json").write_text('{"o": {"a": 1}, "items": [{"b": 2}], "o": {"c": [3]}}')
    assert members(spark, str(tmp_path / "y.json"), "items", whole=("o",))[0]["o"] == {"c": [3]}


def test_a_report_is_read_by_ranges(spark, monkeypatch, small_ranges):
    """No task reads the whole file of report_json_file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    from assay.plans import reports
    from assay.queries import QUERIES

    read, seen = reports.read_json, []
    monkeypatch.setattr(reports, "read_json", lambda s, path: seen.append(read(s, path)) or seen[-1])
    row = QUERIES["report_json_file"](spark, "/root/testdata/sf0.001").first()
    (head, items), = seen
    assert items.rdd.getNumPartitions() >= 4 and row.items == items.count() == head["summary"]["totalExamples"] > 0 and head["config"] == {"runs": 2}
