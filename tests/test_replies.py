"""The table of replies: what is asked, how often, and what a failed run leaves."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import judges as jd
from assay.operators.replies import Replies
from assay.plans.experiment import Experiment
from assay.sources import datasets as ds


def told(log):
    return [line for line in log.read_text().splitlines()] if log.exists() else []


def counting(log, fail=None):
    """A judge that writes down each prompt that it gets."""

    def judge(prompts):
        out = []
        for p in prompts:
            if fail and fail(p):
                raise RuntimeError("the judge is down")
            with open(log, "a") as f:
                f.write(json.dumps(p) + "\n")
            out.append(f"re: {p}")
        return out

    return judge


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    r = Replies(spark, str(tmp_path / "t"), counting(log), every=4)
    df = spark.createDataFrame([(k, f"p{k % 5}" if k % 7 else None) for k in range(40)], "id long, p string")
    got = {x.id: x.r for x in r.on(df, "r", F.col("p")).collect()}
    assert got == {k: f"re: p{k % 5}" if k % 7 else None for k in range(40)} and len(told(log)) == 5 and r.waves == 2
    more = r.on(df.union(spark.createDataFrame([(99, "new")], df.schema)), "r", F.col("p"))
    assert more.count() == 41 and len(told(log)) == 6


def test_a_run_that_failed_asks_only_what_is_missing(spark, tmp_path):
    log, down = tmp_path / "log", tmp_path / "down"
    down.touch()
    df = spark.createDataFrame([(f"p{k}",) for k in range(60)], "p string")
    fail = lambda p: p == "p41" and down.exists()
    with pytest.raises(Exception, match="the judge is down"):
        Replies(spark, str(tmp_path / "t"), counting(log, fail), every=6).on(df, "r", F.col("p"))
    kept = {r.reply for r in Replies(spark, str(tmp_path / "t"), counting(log)).log.state().collect()}
    assert 0 < len(kept) < 60
    down.unlink()
    asked = len(told(log))
    r = Replies(spark, str(tmp_path / "t"), counting(log, fail), every=6)
    assert {x.r for x in r.on(df, "r", F.col("p")).collect()} == {f"re: p{k}" for k in range(60)}
    assert len(told(log)) - asked == 60 - len(kept)


def test_replies_outlive_later_folds(spark, tmp_path):
    """A frame that is not read before later questions have folded the log twice still has its replies; waves are bounded."""
    r = Replies(spark, str(tmp_path / "t"), counting(tmp_path / "log"), every=1)
    r.waves = 31
    df = spark.createDataFrame([(k, f"p{k}") for k in range(3)], "id long, p string")
    lists = df.select("id", F.array("p").alias("ps"))
    one, each = r.on(df, "r", F.col("p")), r.on_each(lists, "r", F.col("ps"))
    for k in range(3):
        r.ask(spark.createDataFrame([(f"more{k}",)], "prompt string"))
        assert r.log.fold()
    assert {x.id: x.r for x in one.collect()} == {k: f"re: p{k}" for k in range(3)}
    assert {x.id: x.r for x in each.collect()} == {k: [f"re: p{k}"] for k in range(3)}
    before = r.waves
    r.ask(spark.range(70).select(F.concat(F.lit("many"), F.col("id").cast("string")).alias("prompt")))
    assert before < r.waves <= before + 64 and r.log.state().count() == 76


def test_lists_of_prompts(spark, tmp_path):
    log = tmp_path / "log"
    r = Replies(spark, str(tmp_path / "t"), counting(log))
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"]), (5, ["a", "b", "a"])], "id long, ps array<string>")
    got = {x.id: x.r for x in r.on_each(df, "r", F.col("ps")).collect()}
    assert got == {1: ["re: a", "re: b", "re: a"], 2: [], 3: None, 4: ["re: b"], 5: ["re: a", "re: b", "re: a"]} and len(told(log)) == 2


def test_evaluators_take_the_table_for_a_judge(spark, tmp_path):
    """The same results as with the judge itself; a second run asks nothing."""
    log = tmp_path / "log"

    def judge(prompts):
        out = []
        for p in prompts:
            with open(log, "a") as f:
                f.write("x\n")
            if p.startswith(("List", "Split the answer into its")):
                out.append('["x", "y"]')
            elif p.startswith("Say for"):
                out.append('[{"verdict": "yes", "reasoning": "r"}, {"verdict": "no", "reasoning": "s"}]')
            elif p.startswith("Split"):
                out.append('[{"verdict": "no", "reason": "r"}]')
            else:
                out.append('{"score": 0.75, "reason": "r"}' if p.startswith(("Say how", "Criteria")) else "sum")
        return out

    d = ds.from_examples(spark, [{"input": f"q{k % 2}"} for k in range(8)])
    task = lambda df: df.withColumn("actual_output", F.col("input")).withColumn("context", F.array("input")).withColumn("retrievalContext", F.array(F.lit("c"), "input"))
    run = lambda j: sorted(tuple(r) for r in Experiment(d, task, [*jd.qa_presets(j, "good?"), jd.ContextualRelevance(j)], "e").run().evals.collect())
    plain = run(judge)
    direct = len(told(log))
    kept = Replies(spark, str(tmp_path / "t"), judge)
    assert run(kept) == plain
    asked = len(told(log)) - direct
    assert asked < direct / 2  # of eight items two differ
    assert run(Replies(spark, str(tmp_path / "t"), judge)) == plain and len(told(log)) == direct + asked
