"""Datasets, experiments, reports, tracking writes and the streaming reporter."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from assay.errors import DatasetResolutionError
from assay.operators import evaluators as ev
from assay.operators.judges import LlmJudge
from assay.plans import reports, tracking
from assay.plans.experiment import Experiment, assert_eval, quality_gate
from assay.sources import datasets as ds
from assay.streaming import reporter as rp


def rows(dataset):
    return [(r.inputs, r.expected_outputs, r.metadata) for r in dataset]


def test_json_forms(spark, tmp_path):
    text = json.dumps({"name": "n", "examples": [{"input": "q", "expectedOutput": "a"}, {"inputs": {"k": "v"}, "input": "ignored", "metadata": {"m": "1"}}]})
    d = ds.from_json_text(spark, text)
    assert (d.name, d.description, d.size()) == ("n", "", 2)
    assert rows(d) == [({"input": "q"}, {"output": "a"}, {}), ({"k": "v"}, {}, {"m": "1"})]
    assert d.get(1).inputs == {"k": "v"}
    (tmp_path / "x.json").write_text(text)
    assert rows(ds.Registry().resolve(spark, f"file:{tmp_path}/x.json")) == rows(d)
    for bad, what in (("{x", "Failed to parse"), ("{}", "examples")):
        with pytest.raises(Exception, match=what):
            ds.from_json_text(spark, bad).size()


def test_csv(spark, tmp_path):
    text = 'Input , expected_output,topic\n"a, b",x, t \n\nsay ""hi"",y\nc,z,u,surplus\n'
    want = [({"input": "a, b"}, {"output": "x"}, {"topic": "t"}), ({"input": "say hi"}, {"output": "y"}, {}), ({"input": "c"}, {"output": "z"}, {"topic": "u"})]
    assert rows(ds.from_csv_text(spark, text, "n")) == want
    (tmp_path / "my.csv").write_text(text)
    got = ds.from_csv(spark, str(tmp_path / "my.csv"))
    assert (got.name, rows(got), [r.example_idx for r in got]) == ("my", want, [0, 1, 2])
    assert rows(ds.from_csv_text(spark, "input;output\na,b;c", delimiter=";")) == [({"input": "a,b"}, {"output": "c"}, {})]
    with pytest.raises(ValueError, match="input"):
        ds.from_csv_text(spark, "a,b\n1,2")
    with pytest.raises(ValueError, match="empty"):
        ds.from_csv_text(spark, " \n")
    line = spark.createDataFrame([('a"b,c',), ("a,,",), ("",)], "v string")
    assert [r.c for r in line.select(ds.cells("v").alias("c")).collect()] == [["ab,c"], ["a", "", ""], [""]]
    (tmp_path / "blank.csv").write_text("\ninput\nx\n")
    with pytest.raises(ValueError, match="needs a column"):
        ds.from_csv(spark, str(tmp_path / "blank.csv"))
    many = "input\n" + "".join(f"line {k}\n\n" for k in range(20_000))
    (tmp_path / "many.csv").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = [(r.example_idx, r.inputs["input"]) for r in ds.from_csv(spark, str(tmp_path / "many.csv"))]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, f"line {k}") for k in range(20_000)]


def test_examples_are_kept_as_json_texts(spark):
    d = ds.from_examples(spark, [{"inputs": {"a": [1, "x"], "b": True, "c": None, "d": "t", "e": {"k": 1.5}}}])
    text = ds.from_json_text(spark, json.dumps({"examples": [{"inputs": {"a": [1, "x"], "b": True, "d": "t", "e": {"k": 1.5}}}]}))
    assert rows(d) == rows(text) == [({"a": '[1,"x"]', "b": "true", "d": "t", "e": '{"k":1.5}'}, {}, {})]
    none = ds.from_examples(spark, [])
    assert [r.example_idx for r in none.add(d).add(d)] == [0, 1]
    assert [e.inputs for e in ds.of_test(spark, "no/such", '{"examples": [{"input": "i"}]}')] == [{"input": "i"}]
    with pytest.raises(ValueError, match="URI or JSON"):
        ds.of_test(spark)


def test_request_adapter(spark):
    schema = "user_text string, response string, documents array<struct<text:string,metadata:map<string,string>>>"
    df = spark.createDataFrame([("u", "r", [("t", {"k": "v"}), (None, {}), None]), ("u", "r", None)], schema)
    assert [(r.inputs, r.actual_output, r.context) for r in ds.test_cases(df).collect()] == [({"input": "u"}, "r", ["t"]), ({"input": "u"}, "r", None)]
    got = df.select(ds.texts_of("documents").alias("t"), ds.texts_with_metadata("documents").alias("m")).collect()
    assert [(r.t, [tuple(m) for m in r.m]) for r in got] == [(["t"], [("t", {"k": "v"})]), ([], [])]
    evals = spark.createDataFrame([(True, "why", '{"n":1}', 0.1)], "success boolean, reason string, metadata string, score double")
    r = ds.evaluation_responses(evals).first()
    assert (r["pass"], r.reason, r.metadata) == (True, "why", {"n": "1", "score": "0.1"})


def test_registry(spark):
    r = ds.Registry()
    r.register(lambda u: u.startswith("mem:"), lambda s, u: ds.from_examples(s, [{"input": u}], u))
    assert r.resolve(spark, "mem:x").name == "mem:x"
    for bad in ("classpath:assay/none.json", "/no/such.json", " "):
        with pytest.raises(DatasetResolutionError):
            r.resolve(spark, bad)


def outcome(spark, runs=2, reporter=None):
    d = ds.from_examples(spark, [{"input": "1", "expected_output": "1"}, {"input": "2", "expected_output": "3"}, {"input": "a|<b>, \"c\"", "expected_output": "x"}])
    task = lambda df: df.withColumn("actual_output", F.col("input"))
    return Experiment(d, task, [ev.exact_match("expected_output", "actual_output"), ev.response_length("actual_output", 1, 1, "Len")], "exp", runs=runs, reporter=reporter).run()


def test_experiment_and_reports(spark, tmp_path):
    o = outcome(spark)
    assert tuple(o.summary()) == (3, 1.0, 2.0, 0.333333, 2)
    assert [(r.evaluator, r.average_score, r.std_dev) for r in o.averages().collect()] == [("Exact Match", 0.333333, 0.0), ("Len", 0.666667, 0.0)]
    j = json.loads(reports.to_json(o))
    assert list(j) == ["version", "experimentName", "timestamp", "description", "metadata", "config", "summary", "items"]
    assert [i["success"] for i in j["items"]] == [True, False, False] and j["items"][0]["evaluations"][0]["scores"] == [1.0, 1.0]
    lines = reports.to_csv(o).splitlines()
    assert lines[0] == "input,expected_output,actual_output,success,exact_match_score,exact_match_pass,len_score,len_pass"
    assert lines[1] == "1,1,1,true,1.0,true,1.0,true" and lines[3].startswith('"a|<b>, ""c""",x,')
    md = reports.to_markdown(o)
    assert "33% (1/3)" in md and "| 2 | 2 | 3 | 2 | Exact Match |" in md and "a\\|<b>" in md
    html = reports.to_html(o, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert "a|&lt;b&gt;, &quot;c&quot;" in html and "2024-01-02 03:04:05" in html and html.count("<details>") == 3 and "<li>Exact Match: 1.000 pass Actual output equals expected output</li>" in html
    reports.write_lines(reports.html_rows(o), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).where("value like '<tr>%'").count() == 3
    with pytest.raises(AssertionError, match="below 0.95"):
        quality_gate(o, pass_rate=0.95)
    quality_gate(o, scores={"Len": 0.6})
    single = json.loads(reports.to_json(outcome(spark, runs=1)))
    assert single["items"][1]["evaluations"][0]["score"] == 0.0 and "scores" not in single["items"][1]["evaluations"][0]


def test_a_judge_is_asked_once(spark, tmp_path):
    """Items and evaluations are written once: a judge that never says the same gives one outcome."""
    log = tmp_path / "asked"

    def judge(prompts):
        with open(log, "a") as f:
            f.write("x\n" * len(prompts))
        return [json.dumps({"score": random.random(), "reason": "r"}) for _ in prompts]

    d = ds.from_examples(spark, [{"input": str(k)} for k in range(4)])
    o = Experiment(d, lambda df: df.withColumn("actual_output", F.col("input")), [LlmJudge(judge, "J", "be good")]).run()
    first = sorted(map(tuple, o.evals.collect()))
    assert o.summary().total == 4 and sorted(map(tuple, o.evals.collect())) == first and len(log.read_text().splitlines()) == 4
    assert sum(r[4] for r in first) / 4 == pytest.approx(o.averages().first().average_score, abs=1e-6)


def test_lifecycle(spark, tmp_path):
    r = rp.FolderReporter(spark, str(tmp_path / "in"))
    outcome(spark, reporter=r)
    q = rp.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    kept = rp.stored(spark, str(tmp_path / "out"))
    assert kept.count() == 6 and r.completed[0][1] == "SUCCESS"
    assert {tuple(e.name for e in x.evals) for x in kept.collect()} == {("Exact Match", "Len")}

    def broken(df):
        raise RuntimeError("task")

    with pytest.raises(RuntimeError):
        Experiment(ds.from_examples(spark, [{"input": "1"}]), broken, [], reporter=r).run()
    assert r.completed[1][1] == "FAILED"
    for bad in ({"runs": 0}, {"parallelism": 0}):
        with pytest.raises(ValueError, match="at least 1"):
            Experiment(ds.from_examples(spark, [{"input": "1"}]), broken, [], **bad)


def test_assert_eval_names_the_first_failure(spark):
    case = spark.createDataFrame([("a", "b")], "e string, a string")
    with pytest.raises(AssertionError, match=r"Exact Match: score 0.00 \(threshold 1.00\)"):
        assert_eval(case, [ev.response_length("a", 1, 1), ev.exact_match("e", "a"), ev.regex_match("a", "z")])
    assert_eval(case, [ev.regex_match("a", "b")])


def test_settings_and_offline_handles(spark, monkeypatch):
    monkeypatch.delenv("ASSAY_REPORTER_URL", raising=False)
    with pytest.raises(ValueError, match="url"):
        rp.Settings.of(spark)
    monkeypatch.setenv("ASSAY_REPORTER_URL", "http://h/")
    monkeypatch.setenv("ASSAY_REPORTER_PROJECT", "p")
    assert rp.Settings.of(spark) == rp.Settings("http://h", "p", None, "v1")

    def down(name, metadata):
        raise OSError

    assert rp.FolderReporter(spark, "x", down).start_run("n", {}).startswith("local-")
    assert rp.FolderReporter(spark, "x", lambda n, m: "id").start_run("n", {}) == "id"


def store(spark):
    t = "2024-01-0{} 00:00:00".format
    make = lambda rows, schema: spark.createDataFrame(rows, "string").select(F.from_csv("value", schema, {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("r")).select("r.*")
    return tracking.Store(
        make([f"p,P,{t(1)}", f"q,Q,{t(2)}"], "project_id string, name string, created_at timestamp"),
        make([f"e,p,E,{t(1)}", f"f,p,F,{t(2)}"], "experiment_id string, project_id string, name string, created_at timestamp"),
        make([f"r1,e,SUCCESS,,{t(1)},{t(1)}", f"r2,e,RUNNING,,{t(2)},", f"r3,e,CANCELLED,,{t(3)},{t(3)}", f"r4,f,FAILED,,{t(1)},{t(1)}"], "run_id string, experiment_id string, status string, config string, started_at timestamp, completed_at timestamp"),
        make([f"i1,r1,a,,x,,{t(1)}", f"i2,r1,b,,y,,{t(2)}", f"i3,r1,c,,z,,{t(3)}"], "item_id string, run_id string, input string, expected_output string, actual_output string, metadata string, created_at timestamp"),
        make(["v1,r1,i1,A,1.0,0.5,true,", "v2,r1,i2,A,0.0,0.5,false,no"], "eval_id string, run_id string, item_id string, evaluator string, score double, threshold double, success boolean, reason string"),
    )


def test_one_run_reads_only_its_rows(spark, tmp_path):
    """The run's id is pushed down to the scans of items and evaluations, and a project's list cuts both before it aggregates."""
    s = store(spark)
    for name in ("items", "evals", "runs"):
        getattr(s, name).write.parquet(f"{tmp_path}/{name}")
        setattr(s, name, spark.read.parquet(f"{tmp_path}/{name}"))
    mine = F.col("run_id") == "r1"
    plan = tracking.run_counts(s.runs.where(mine), s.items.where(mine), s.evals.where(mine), every=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(run_id,r1)") == 3
    assert [(r.total, r.passed) for r in tracking.run_counts(s.runs.where(mine), s.items, s.evals).collect()] == [(3, 1)]
    plan = tracking.run_counts(s.runs.where(mine), s.items, s.evals)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("EqualTo(run_id,r1)") >= 3


def test_pager_and_table_order(spark):
    assert [tuple(tracking.shown(*a).values()) for a in ((45, 0), (45, 2), (0, 0))] == [(1, 20, 45, 3), (41, 45, 45, 3), (0, 0, 0, 0)]
    df = spark.createDataFrame([("9%",), ("10%",), ("b",), ("a",)], "v string")
    assert [r.v for r in tracking.table_order(df, "v").collect()] == ["9%", "10%", "a", "b"]
    assert [r.v for r in tracking.table_order(df, "v", descending=True).collect()] == ["10%", "9%", "b", "a"]


def test_tracking(spark):
    s = store(spark)
    assert [(r.name, r.experiment_count) for r in tracking.list_projects(s).collect()] == [("Q", 0), ("P", 2)]
    assert [(r.experiment_id, r.run_id, r.pass_rate) for r in tracking.list_experiments(s, "p").collect()] == [("f", "r4", None), ("e", "r3", None)]
    assert {r.run_id: (r.total, r.passed, r.pass_rate) for r in tracking.list_runs(s).collect()} == {"r1": (3, 1, 1 / 3), "r2": (0, 0, None), "r3": (0, 0, None), "r4": (0, 0, None)}
    assert [(r.run_id, r.pass_rate) for r in tracking.trends(s).collect()] == [("r1", 1 / 3), ("r4", 0.0)]
    d = tracking.run_details(s, "r1", page=0, size=2)
    assert (d["run"].project, d["run"].experiment, d["pages"], [len(r.evaluations) for r in d["items"].collect()]) == ("P", "E", 2, [1, 1])
    assert [r.item_id for r in tracking.run_page(s, "r1", 1, 2).collect()] == ["i3"]
    with pytest.raises(tracking.NotFound):
        tracking.run_details(s, "none")
    with pytest.raises(tracking.NotFound):
        tracking.find(s.projects, name="none")
    done = {r.run_id: r for r in tracking.set_status(s.runs, "r2", "SUCCESS").collect()}
    assert done["r2"].status == "SUCCESS" and done["r2"].completed_at is not None and done["r1"].status == "SUCCESS"
    assert [r.name for r in tracking.new_projects(s.projects, spark.createDataFrame([("P",), ("N",), ("N",)], "name string")).collect()] == ["N"]
    assert tracking.new_run(s.experiments.where("experiment_id = 'e'")).first().status == "RUNNING"
    table = tracking.run_table(s, "r1", ["A"]).orderBy("item_id").collect()
    assert [(r.item_id, r.A_score, r.A_success) for r in table] == [("i1", 1.0, True), ("i2", 0.0, False), ("i3", None, None)]


def test_equal_items_of_two_requests_are_two(spark):
    """A run's requests with equal items at equal places are stored each; the same request sent again gives the same ids."""
    eval_ = [("E", 1.0, None, True, "")]
    one = ("r", [({"input": "q"}, {}, {"output": "a"}, eval_), ({"input": "q"}, {}, {"output": "a"}, eval_)])
    kind = "run_id string, items array<struct<inputs:map<string,string>,expectedOutputs:map<string,string>,actualOutputs:map<string,string>,evalResults:array<struct<name:string,score:double,threshold:double,success:boolean,reason:string>>>>"
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    items, evals = tracking.added_items(spark.createDataFrame([one, one, ("unknown", one[1])], kind), runs)
    assert items.select("item_id").distinct().count() == evals.select("eval_id").distinct().count() == 4
    counts = {r.run_id: (r.total, r.passed) for r in tracking.run_counts(runs, items, evals).collect()}
    assert counts == {"r": (4, 4), "empty": (0, 0)}
    ids = lambda call: {r.item_id for r in tracking.added_items(spark.createDataFrame([one], kind), runs, call)[0].collect()}
    assert ids("x") == ids("x") and not ids("x") & ids("y") and not ids(None) & ids(None)
    numbered = spark.createDataFrame([(*one, 0), (*one, 1)], kind + ", request long")
    first, again = ({r.item_id for r in tracking.added_items(numbered, runs)[0].collect()} for _ in range(2))
    assert first == again and len(first) == 4


def test_an_empty_dataset_gives_zeros(spark):
    none = ds.from_examples(spark, [{"input": "x"}])
    none.frame = none.frame.where("false")
    o = Experiment(none, lambda df: df.withColumn("actual_output", F.col("input")), [ev.exact_match("expected_output", "actual_output")], "none", runs=3).run()
    s = o.summary()
    assert (s.total, s.passed, s.failed, s.pass_rate, s.runs) == (0, 0.0, 0.0, 0.0, 3)
    assert "**Pass rate:** 0% (0/0)" in reports.to_markdown(o) and json.loads(reports.to_json(o))["summary"]["passRate"] == 0.0
    assert reports.to_csv(o).count("\n") == 1 and "Pass rate" in reports.to_html(o)


def test_csv_columns_of_odd_evaluator_names(spark):
    names = ["Exact Match", "exact_match", "a`b", "x.y"]
    d = ds.from_examples(spark, [{"input": "q", "expectedOutput": "q"}])
    o = Experiment(d, lambda df: df.withColumn("actual_output", F.col("input")), [ev.response_length("input", k, 9, n) for k, n in enumerate(names)], "odd").run()
    head, line = reports.to_csv(o).splitlines()
    order = sorted(names)
    assert head.split(",")[4:] == [f"{n.lower().replace(' ', '_')}_{k}" for n in order for k in ("score", "pass")]
    want = [f"{1.0 if names.index(n) <= 1 else 0.0},{'true' if names.index(n) <= 1 else 'false'}" for n in order]
    assert line == "q,,q,false," + ",".join(want)
    from assay.operators import results

    assert results.pivoted(o.evals, ["item_idx"], order).columns == ["item_idx", "exact_match_score", "exact_match_pass", "a`b_score", "a`b_pass", "exact_match_2_score", "exact_match_2_pass", "x.y_score", "x.y_pass"]


def test_report_files_are_the_texts(spark, tmp_path):
    """Written by parts, each report holds the bytes of the text that the driver makes."""
    when = dt.datetime(2024, 5, 6, 7, 8, 9)
    many = ds.from_examples(spark, [{"input": f"q{k}\n\"é|", "expected_output": f"Q{k}" if k % 3 else f"q{k}\n\"é|"} for k in range(300)])
    many.frame = many.frame.repartition(7)
    none = ds.from_examples(spark, [{"input": "x"}])
    none.frame = none.frame.where("false")
    for name, d in (("many", many), ("none", none)):
        o = Experiment(d, lambda df: df.withColumn("actual_output", F.col("input")), [ev.exact_match("expected_output", "actual_output"), ev.response_length("input", 1, 2, "Len")], name, runs=2).run()
        made = {"json": reports.json_report(o, when), "csv": reports.csv_report(o), "md": reports.markdown_report(o), "html": reports.html_report(o, when)}
        for kind, report in made.items():
            report.write(f"file://{tmp_path}/r/{name}.{kind}")
            text = report.text()
            assert (tmp_path / "r" / f"{name}.{kind}").read_text(encoding="utf-8") == text
        data = json.loads(made["json"].text())
        assert json.dumps(data, indent=2, ensure_ascii=False) == made["json"].text() and len(data["items"]) == (300 if name == "many" else 0)
    reports.write_report(o, str(tmp_path / "x.md"))
    assert (tmp_path / "x.md").read_text() == reports.to_markdown(o)
    with pytest.raises(KeyError):
        reports.write_report(o, str(tmp_path / "x.doc"))


def test_an_outcome_takes_its_tables_with_it(spark):
    d = ds.from_examples(spark, [{"input": "x"}])
    with Experiment(d, lambda df: df.withColumn("actual_output", F.col("input")), [ev.response_length("input", 1, 1)], "gone").run() as o:
        folder = o.scratch.path.removeprefix("file://")
        assert o.summary().passed == 1.0 and os.path.exists(f"{folder}/items")
    assert not os.path.exists(folder)
    kept = []
    save = lambda name, df: kept.append(name) or df
    o = Experiment(d, lambda df: df.withColumn("actual_output", F.col("input")), [ev.response_length("input", 1, 1)], "own", save=save).run()
    o.close()
    assert kept == ["items", "evals"] and o.summary().total == 1


def test_rows_by_run_are_dealt_to_partitions_of_bounded_size(spark, tmp_path, monkeypatch):
    """However large the tables are, a partition of a trend, a run table or a pivot holds a bounded share of them."""
    from assay import shared
    from assay.sources import domain

    sf = "/root/testdata/sf0.01"
    n = lambda df: df.rdd.getNumPartitions()
    few, many = shared.dealt(domain.table(spark, sf, "lineitem"), "l_orderkey", each=1 << 30), shared.dealt(domain.table(spark, sf, "lineitem"), "l_orderkey", each=1 << 16)
    assert n(few) <= 4 < 12 <= n(many)
    share = max(r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert share < 3 * many.count() / n(many)
    assert "REPARTITION_BY_NUM" in domain.plain_evals(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_added_items_are_made_once(spark):
    """Items and evaluations are read from what was written: neither numbers the requests anew."""
    kind = "run_id long, items array<struct<inputs:map<string,string>,expectedOutputs:map<string,string>,actualOutputs:map<string,string>,evalResults:array<struct<name:string,score:double,threshold:double,success:boolean,reason:string>>>>"
    item = ({"a": "b"}, {}, {"o": "p"}, [("e", 1.0, 0.5, True, "")])
    payload = spark.createDataFrame([(1, [item, item]), (1, [item, item]), (2, [item])], kind)
    items, evals = tracking.added_items(payload, spark.createDataFrame([(1,)], "run_id long"), call="c")
    assert items.count() == evals.count() == items.select("item_id").distinct().count() == 4
    assert all("Window" not in f._jdf.queryExecution().executedPlan().toString() for f in (items, evals))
