"""Evaluators and aggregates on stated values."""

import json

import pytest
from pyspark.sql import functions as F

from assay.errors import EvaluationError
from assay.operators import evaluators as ev
from assay.operators import judges as jd
from assay.operators import results as rs
from assay.sources import adapters as ad


def run(spark, column, schema="x string", *rows):
    df = spark.createDataFrame(list(rows) or [("x",)], schema)
    return [r.r for r in df.select(column.alias("r")).collect()]


def test_exact_and_regex(spark):
    got = run(spark, ev.exact_match("a", "b"), "a string, b string", ("x", "x"), ("x", "y"))
    assert [(r.score, r.success) for r in got] == [(1.0, True), (0.0, False)]
    assert [r.success for r in run(spark, ev.regex_match("x", r"\d+"), "x string", ("a1b",), ("ab",))] == [True, False]
    assert [r.success for r in run(spark, ev.regex_match("x", "ABC", True), "x string", ("xabcx",))] == [True]


@pytest.mark.parametrize(
    ("retrieved", "relevant", "p", "r"),
    [(["a", "b", "c"], ["a", "b"], 2 / 3, 1.0), ([], ["a"], 1.0, 0.0), (["a"], [], 0.0, 1.0), (["a", "a", "b"], ["a"], 2 / 3, 2.0), ([], [], 1.0, 1.0)],
)
def test_precision_recall(spark, retrieved, relevant, p, r):
    df = spark.createDataFrame([(retrieved, relevant)], "a array<string>, b array<string>")
    got = df.select(ev.precision("a", "b").alias("p"), ev.recall("a", "b").alias("r")).first()
    assert (got.p.score, got.r.score) == (p, r)


def test_retrieval_reasons_and_metadata(spark):
    rows = [(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a"]), (["x"], ["a"]), ([], ["a"]), (["a"], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(ev.precision("a", "b").alias("p"), ev.recall("a", "b").alias("r")).collect()
    assert [g.p.reason for g in got] == [
        "Retrieved 3 items: 2 relevant, 1 irrelevant. Precision: 66.7%", "All 1 retrieved items are relevant (perfect precision).", "None of the 1 retrieved items are relevant.",
        "No items were retrieved. Precision is 1.0 by convention.", "None of the 1 retrieved items are relevant.",
    ]
    assert [g.r.reason for g in got] == [
        "Found 2 of 3 relevant items (1 missed). Recall: 66.7%", "All 1 relevant items were retrieved (perfect recall).", "None of the 1 relevant items were retrieved.",
        "None of the 1 relevant items were retrieved.", "No relevant items in ground truth. Recall is 1.0 by convention.",
    ]
    assert json.loads(got[0].p.metadata) == {"retrieved": 3, "relevant": 3, "truePositives": 2}


def test_collections_of_json_texts(spark):
    make = lambda v: ev.collection(F.create_map(F.lit("k"), F.lit(v)), "k", "Recall", "expectedOutputs")
    assert [run(spark, make(v))[0] for v in ('["a", 1]', "plain", "[not json", "5", "[]")] == [["a", "1"], ["plain"], ["[not json"], ["5"], []]
    with pytest.raises(Exception, match="Recall evaluator requires 'other' in expectedOutputs"):
        run(spark, ev.collection(F.create_map(F.lit("k"), F.lit("v")), "other", "Recall", "expectedOutputs"))


def test_judge(spark):
    replies = ('```json\n{"score": 0.9, "reason": "fine"}\n```', '{"score": 1.7}', '{"score": 0.2, "reason": "bad"}', "oops", None)
    got = run(spark, ev.llm_judge("x", "q"), "x string", *((r,) for r in replies))
    assert [(r.score, r.threshold, r.success) for r in got] == [(0.9, 0.5, True), (1.7, 0.5, True), (0.2, 0.5, False), (0.0, None, False), (0.0, None, False)]
    assert got[1].reason == "No reason provided." and got[3].reason == "Failed to parse LLM response: oops"


def test_ratios(spark):
    v = '[{"verdict": "YES"}, {"verdict": " no "}, {"verdict": "idk", "reasoning": "r"}, {"verdict": "yes"}]'
    got = run(spark, ev.faithfulness("c", "v"), "c string, v string", ('["a","b","c","d"]', v), ("[]", "[]"))
    assert [(r.score, r.success) for r in got] == [(0.5, False), (1.0, True)]
    got = run(spark, ev.hallucination("x", threshold=0.25), "x string", (v,), ("[]",), ('[{"verdict":"no"}]',))
    assert [(r.score, r.success, r.threshold) for r in got] == [(0.25, True, None), (0.0, True, None), (1.0, False, None)]
    with pytest.raises(Exception, match="Failed to parse verdicts"):
        run(spark, ev.hallucination("x"), "x string", ("not json",))


def test_contextual_relevance(spark):
    reply = lambda s: f'{{"score": {s}, "reason": ""}}'
    got = run(spark, ev.contextual_relevance("x"), "x array<string>", ([reply(1.5), reply(-0.5)],), ([],), ([reply(0.9), reply(0.7), reply(0.3)],))
    assert [round(r.score, 3) for r in got] == [0.5, 0.0, 0.633]
    assert got[1].reason == "No retrieval context provided to evaluate." and got[0].success
    assert [r.success for r in run(spark, ev.contextual_relevance("x", strict=True), "x array<string>", ([reply(0.99)],))] == [False]
    with pytest.raises(Exception, match="not a number"):
        run(spark, ev.contextual_relevance("x"), "x array<string>", ([reply('"high"')],))


def test_results_and_required(spark):
    got = run(spark, ev.result("n", F.col("x")), "x double", (0.5,), (0.4,), (float("nan"),))
    assert [r.success for r in got] == [True, False, False]
    both = "a string, b string"
    for at, row in (("EXPECTED_OUTPUT", (None, "x")), ("ACTUAL_OUTPUT", ("x", None)), ("ACTUAL_OUTPUT", (None, None))):
        with pytest.raises(Exception, match=f"Metric 'Exact Match' requires '{at}' but it was null in the test case."):
            run(spark, ev.exact_match("a", "b"), both, row)
        told = run(spark, ev.exact_match("a", "b", missing="report"), both, row)[0]
        assert (told.score, told.success, told.reason) == (0.0, False, f"Metric 'Exact Match' requires '{at}' but it was null in the test case.")
    with pytest.raises(Exception, match="requires 'ACTUAL_OUTPUT'"):
        run(spark, ev.regex_match("x", "a"), "x string", (None,))
    with pytest.raises(ValueError, match="missing"):
        ev.exact_match("a", "b", missing="ignore")
    assert run(spark, ev.keyword_coverage("x", ["A", "zz"]), "x string", ("has a",))[0].score == 0.5
    assert run(spark, ev.keyword_coverage("x", []), "x string", ("has a",))[0].score == 1.0
    assert run(spark, ev.response_length("x", 2, 3), "x string", ("one two",))[0].success


def test_judged_in_batches(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string")
    got = ev.judged(df, "prompt", "reply", lambda prompts: [p.upper() for p in prompts]).orderBy("i").collect()
    assert [r.reply for r in got] == [f"P{i}" for i in range(20)]
    text = run(spark, ev.judge_prompt("be kind", {"Input": "x"}), "x string", ("hello",))[0]
    assert text.startswith("Criteria:\nbe kind\n\nInput:\nhello")
    with pytest.raises(ValueError, match="parameter"):
        ev.judge_prompt("c", {})


EVALS = "run_index int, item_idx int, evaluator_idx int, evaluator string, score double, threshold double, success boolean, reason string"


def test_two_level_means(spark):
    rows = [(0, 0, 0, "a", 0.6, None, True, ""), (0, 1, 0, "a", 0.6, None, True, ""), (1, 0, 0, "a", 0.8, 0.5, False, "why"), (1, 1, 0, "a", 0.8, 0.5, True, "")]
    evals = spark.createDataFrame(rows, EVALS)
    means = rs.run_averages(evals, evals.select("run_index").distinct(), ["run_index"])
    got = rs.experiment_averages(means, []).first()
    assert (got.average_score, got.std_dev) == (0.7, 0.141421)
    items = rs.item_results(evals.select("run_index", "item_idx").distinct(), evals, ["run_index", "item_idx"])
    s = rs.experiment_summary(rs.run_summary(items, ["run_index"]), []).first()
    assert (s.total, s.passed, s.failed, s.pass_rate, s.runs) == (2, 1.5, 0.5, 0.75, 2)
    item = rs.item_across_runs(evals, []).where("item_idx = 0").first()
    assert (item.scores, item.threshold, item.reason, item.success) == ([0.6, 0.8], 0.5, "why", False)
    assert [tuple(r) for r in rs.first_failures(items, []).collect()] == [(0, 1)]


def test_empty_evaluations_pass(spark):
    items = spark.createDataFrame([(0, 0)], "run_index int, item_idx int")
    got = rs.item_results(items, spark.createDataFrame([], EVALS), ["run_index", "item_idx"]).first()
    assert got.success is True


def test_pivot_takes_the_last_repeat(spark):
    rows = [(0, 0, 0, "My Eval", 0.1, None, False, ""), (0, 0, 1, "My Eval", 0.9, None, True, "")]
    got = rs.pivoted(spark.createDataFrame(rows, EVALS), ["item_idx"], ["My Eval", "other"]).first()
    assert got.asDict() == {"item_idx": 0, "my_eval_score": 0.9, "my_eval_pass": True, "other_score": None, "other_pass": None}


def test_item_cross_run_agg_gathers_no_list(spark):
    from assay.queries import QUERIES

    plan = QUERIES["item_cross_run_agg"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan and "collect_list" not in plan


def test_item_scores_are_rows_in_run_order(spark):
    rows = [(1, 0, 0, "a", 0.8, None, True, ""), (0, 0, 1, "a", None, None, True, ""), (0, 0, 0, "a", 0.6, None, True, ""), (0, 1, 0, "a", 0.1, None, True, "")]
    evals = spark.createDataFrame(rows, EVALS)
    assert [(r.item_idx, r.run_index, r.score) for r in rs.item_scores(evals, []).collect()] == [(0, 0, 0.6), (0, 0, None), (0, 1, 0.8), (1, 0, 0.1)]
    assert [(r.item_idx, r.n) for r in rs.item_across_runs(evals, []).orderBy("item_idx").collect()] == [(0, 3), (1, 1)]


def scripted(replies):
    """A judge that answers by the beginning of a prompt, and what it was asked."""
    asked = []

    def judge(prompts):
        asked.extend(prompts)
        return [next(v for k, v in replies.items() if p.startswith(k)) for p in prompts]

    return judge, asked


def stage(df, s):
    df, r = s.on(df, "_e")
    return [x.r for x in df.select(r.alias("r")).collect()]


def test_faithfulness_asks_for_truths_claims_verdicts_and_a_summary(spark):
    df = spark.createDataFrame([("q", "a", ["c1", "c2"])], "input string, actual_output string, context array<string>")
    judge, _ = scripted({"List the facts": '["t"]', "Split": '```json\n["x", "y"]\n```', "Say for each claim whether": '[{"verdict": "yes", "reasoning": "r"}, {"verdict": "No"}]', "Sum up": " so so \n"})
    got = stage(df, jd.Faithfulness(judge))[0]
    assert (got.name, got.score, got.success, got.reason, got.threshold) == ("Faithfulness", 0.5, False, "so so", 0.8)
    judge, _ = scripted({"List": "[]", "Split": "[]", "Say": "[]"})
    assert [(r.score, r.reason) for r in stage(df, jd.Faithfulness(judge))] == [(1.0, "No claims were found to evaluate.")]
    assert stage(df, jd.Faithfulness(judge, include_reason=False))[0].reason == "Reasoning was disabled"
    broken, _ = scripted({"List": "oops", "Split": "[]", "Say": "[]"})
    with pytest.raises(Exception, match="Failed to parse truths"):
        stage(df, jd.Faithfulness(broken))
    with pytest.raises(EvaluationError, match="Faithfulness requires 'other' in actualOutputs"):
        jd.Faithfulness(judge, context="other").on(df, "_e")
    for row, what in ((("q", "a", None), "requires 'context' in actualOutputs"), ((None, "a", ["c"]), "requires 'INPUT'")):
        with pytest.raises(Exception, match=what):
            stage(spark.createDataFrame([row], df.schema), jd.Faithfulness(judge))
    told = stage(spark.createDataFrame([(None, "a", ["c"])], df.schema), jd.Faithfulness(judge, missing="report"))[0]
    assert (told.score, told.success) == (0.0, False) and "requires 'INPUT'" in told.reason


def test_hallucination_succeeds_at_or_below_the_threshold(spark):
    df = spark.createDataFrame([("q", "a", "c")], "input string, actual_output string, context string")
    judge, _ = scripted({"Split": '[{"verdict": " NO ", "reason": "n"}, {"verdict": "yes", "reason": "y"}]', "Sum up": "half"})
    assert [(r.score, r.success, r.threshold, r.reason) for t in (0.5, 0.4) for r in stage(df, jd.Hallucination(judge, threshold=t))] == [(0.5, True, None, "half"), (0.5, False, None, "half")]
    judge, _ = scripted({"Split": "[]"})
    assert [(r.score, r.success, r.reason) for r in stage(df, jd.Hallucination(judge))] == [(0.0, True, "No statements were found to evaluate.")]


def test_contextual_relevance_scores_each_chunk(spark):
    df = spark.createDataFrame([("q", ["one", "two"]), ("q", [])], "input string, retrievalContext array<string>")
    judge, _ = scripted({"Say": '{"score": "0.6"}', "Sum up": "fine"})
    got = stage(df, jd.ContextualRelevance(judge))
    assert [(r.score, r.success, r.reason) for r in got] == [(0.6, True, "fine"), (0.0, False, "No retrieval context provided to evaluate.")]
    assert json.loads(got[0].metadata)["contextScores"] == [{"context": c, "score": 0.6, "reason": "No reason provided"} for c in ("one", "two")]
    assert json.loads(got[1].metadata) == {"contextScores": []}
    one = spark.createDataFrame([("q", "text")], "input string, retrievalContext string")
    assert [r.success for r in stage(one, jd.ContextualRelevance(judge, strict=True, include_reason=False))] == [False]
    with pytest.raises(EvaluationError, match="to be a list of texts or a text, but got: int"):
        jd.ContextualRelevance(judge).on(spark.createDataFrame([("q", 1)], "input string, retrievalContext int"), "_e")


def test_matches_by_judge(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["x", "A"]), ([], ["x"]), (["a"], [])], "retrieved array<string>, relevant array<string>")
    judge = lambda prompts: ["```\nYes.\n```" if p.rsplit("Expected: ", 1)[1].lower() == p.split("Retrieved: ", 1)[1][0] else "no" for p in prompts]
    assert [round(r.score, 3) for r in stage(df, jd.LlmRetrieval(judge))] == [0.667, 1.0, 0.0]
    assert [r.score for r in stage(df, jd.LlmRetrieval(judge, of=ev.recall, name="Recall"))] == [1.0, 0.0, 1.0]


def test_presets_in_an_experiment_frame(spark):
    df = spark.createDataFrame([("q", "a", ["c"])], "input string, actual_output string, context array<string>")
    judge, _ = scripted({"List": '["t"]', "Split the answer into its": '["x"]', "Split": '[{"verdict": "yes", "reason": "r"}]', "Say for": '[{"verdict": "yes", "reasoning": "r"}]', "Say how": '{"score": 0.7, "reason": "r"}', "Criteria": '{"score": 0.65, "reason": "r"}', "Sum up": "s"})
    got = ev.evaluated(df, [*jd.qa_presets(judge, "Is it short and right?"), ev.response_length("actual_output", 1, 1)]).orderBy("evaluator_idx").collect()
    assert [(r.evaluator, r.score, r.success) for r in got] == [("Faithfulness", 1.0, True), ("Hallucination", 0.0, True), ("Answer Quality", 0.65, False), ("ContextualRelevance", 0.7, True), ("Response Length", 1.0, True)]


def test_adapters(spark):
    df = spark.createDataFrame([("q", {"a": "1"}), (None, {})], "input string, inputs map<string,string>")
    assert [r.actual_output for r in ad.simple_task(str.upper)(df).collect()] == ["Q", None]
    assert [(r.actual_output, r.context) for r in ad.rag_task(lambda t: (t + "!", ["c1", "c2"]))(df).collect()] == [("q!", ["c1", "c2"]), (None, None)]
    assert [(r.actual_output, r.extra) for r in ad.custom_task(lambda m: {"output": str(len(m)), "extra": "e"}, ["output", "extra", "none"])(df).collect()] == [("1", "e"), ("0", "e")]
    assert ad.judge_of(str.upper)(["a"]) == ["A"]
    for model, prompts in ((lambda p: None, ["a"]), (str.upper, [None])):
        with pytest.raises(EvaluationError):
            ad.judge_of(model)(prompts)


def test_costly_parts_are_computed_once(spark):
    """However many fields of a result are read, a pattern, a match and a parse stand once in the plan."""
    texts = spark.createDataFrame([("a", ["a"], ["b"], "[]", "{}")], "t string, r array<string>, e array<string>, j string, o string")

    def times(result, what):
        plan = texts.select(result.alias("r")).select("r.score", "r.success", "r.reason", "r.metadata")._jdf.queryExecution().executedPlan().toString()
        return plan.lower().count(what)

    assert times(ev.regex_match("t", "a+b"), "rlike") == 1
    assert times(ev.precision("r", "e", input="t"), "exists(") == times(ev.recall("r", "e"), "exists(") == 1
    assert times(ev.faithfulness("j", "j"), "from_json(") == 2 and times(ev.hallucination("j"), "from_json(") == 1
    assert times(ev.llm_judge("o", "J"), "from_json(") == 1
    assert times(ev.contextual_relevance("r"), "from_json(") == 1


def test_retrieval_asks_for_the_input(spark):
    frame = spark.createDataFrame([(None, ["a"], ["a"])], "input string, r array<string>, e array<string>")
    for metric in (ev.precision, ev.recall):
        assert frame.select(metric("r", "e", input="input", missing="report")["success"]).first()[0] is False
        with pytest.raises(Exception, match="requires 'INPUT'"):
            frame.select(metric("r", "e", input="input")).collect()
        assert frame.select(metric("r", "e")["score"]).first()[0] == 1.0
