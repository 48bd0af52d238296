"""Evaluators: functions from Columns to one result struct (name, score, threshold, success, reason, metadata).

Those that need a judge take its reply as a Column; the stages of ``judges`` make such Columns from prompts, in batches.
A payload that cannot be read raises, save for the criteria judge, where it is a failed result. A required parameter that is null raises too, or
with ``missing="report"`` gives a failed result with the same words. Metadata is JSON text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clamp01, strip, strip_markdown, word_count
from .matching import Strategy, by_equality, count_matches

_FIELDS = {"name": T.StringType(), "score": T.DoubleType(), "threshold": T.DoubleType(), "success": T.BooleanType(), "reason": T.StringType(), "metadata": T.StringType()}
RESULT = T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()])
OFF = "Reasoning was disabled"


def result(name: str, score: Column, threshold: float | None = None, success: Column | None = None, reason: Column | str | None = None, shown: bool = True, metadata: Column | None = None) -> Column:
    """A result struct. Without ``success`` the score must reach the threshold, or 0.5 if there is none; NaN reaches nothing."""
    score = score.cast("double")
    reached = (score >= F.lit(0.5 if threshold is None else threshold)) & ~F.isnan(score)
    return F.struct(
        F.lit(name).alias("name"), score.alias("score"), F.lit(threshold if shown else None).cast("double").alias("threshold"),
        F.coalesce(reached if success is None else success, F.lit(False)).alias("success"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"),
        (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it; columns go in by the value, as a UDF's reply cannot stand in the body."""
    return F.transform(F.array(value), body)[0]


def required(of: Column, name: str, missing: str = "raise", **parameters: Column | str) -> Column:
    """The result ``of`` an evaluator where its parameters, told by what they are called, are there."""
    if missing not in ("raise", "report"):
        raise ValueError("missing is 'raise' or 'report'")
    for parameter, value in reversed(parameters.items()):
        why = f"Metric '{name}' requires '{parameter}' but it was null in the test case."
        stop = F.raise_error(F.lit(why)).cast(RESULT) if missing == "raise" else result(name, F.lit(0.0), success=F.lit(False), reason=why)
        of = F.when(_col(value).isNull(), stop).otherwise(of)
    return of


def exact_match(expected: Column | str, actual: Column | str, name: str = "Exact Match", threshold: float = 1.0, missing: str = "raise") -> Column:
    def told(same: Column) -> Column:
        return result(name, same.cast("int"), threshold, reason=F.when(same, F.lit("Actual output equals expected output")).otherwise(F.lit("Actual output differs from expected output")))

    return required(let(_col(expected) == _col(actual), told), name, missing, ACTUAL_OUTPUT=actual, EXPECTED_OUTPUT=expected)


def regex_match(actual: Column | str, pattern: str, ignore_case: bool = False, name: str = "Regex Match", threshold: float = 1.0, missing: str = "raise") -> Column:
    """1 if the pattern is found anywhere."""
    def told(found: Column) -> Column:
        return result(name, found.cast("int"), threshold, reason=F.when(found, F.lit("Pattern found")).otherwise(F.lit("Pattern not found")))

    return required(let(_col(actual).rlike(("(?i)" if ignore_case else "") + pattern), told), name, missing, ACTUAL_OUTPUT=actual)


def collection(source: Column | str, key: str, metric: str, where: str) -> Column:
    """The list under ``key`` in a map of JSON texts; a value that is no list is a list of one; without the key the query stops."""
    value = F.try_element_at(_col(source), F.lit(key))
    stop = F.raise_error(F.lit(f"{metric} evaluator requires '{key}' in {where}")).cast("array<string>")
    many = lambda v: F.coalesce(F.when(v.rlike(r"^\s*\["), F.from_json(v, "array<string>")), F.array(v))
    return let(value, lambda v: F.when(v.isNull(), stop).otherwise(many(v)))


def precision(retrieved: Column | str, relevant: Column | str, strategy: Strategy | None = None, name: str = "Precision", threshold: float = 0.5, hits: Column | None = None, input: Column | str | None = None, missing: str = "raise") -> Column:
    """Share of the retrieved items, repeats included, that match; 1 if nothing was retrieved. ``hits``: matches counted by other means; ``input``: must not be null."""

    def told(x: Column) -> Column:
        n, size, hits = x["n"], x["size"], x["hits"]

        def of(score: Column) -> Column:
            reason = (
                F.when(n == 0, F.lit("No items were retrieved. Precision is 1.0 by convention."))
                .when(score == 1.0, F.format_string("All %d retrieved items are relevant (perfect precision).", n))
                .when(score == 0.0, F.format_string("None of the %d retrieved items are relevant.", n))
                .otherwise(F.format_string("Retrieved %d items: %d relevant, %d irrelevant. Precision: %.1f%%", n, hits, n - hits, score * 100))
            )
            return result(name, score, threshold, reason=reason, metadata=_retrieval(n, size, F.when(n == 0, F.lit(0)).otherwise(hits)))

        return of(F.when(n == 0, F.lit(1.0)).otherwise(hits.cast("double") / n))

    out = let(_sizes(retrieved, relevant, strategy, hits), told)
    return out if input is None else required(out, name, missing, INPUT=input)


def recall(retrieved: Column | str, relevant: Column | str, strategy: Strategy | None = None, name: str = "Recall", threshold: float = 0.5, hits: Column | None = None, input: Column | str | None = None, missing: str = "raise") -> Column:
    """Matching retrieved items per relevant item; repeats can take it over 1; 1 if nothing is relevant. ``input``: must not be null."""

    def told(x: Column) -> Column:
        n, size, hits = x["n"], x["size"], x["hits"]

        def of(score: Column) -> Column:
            reason = (
                F.when(size == 0, F.lit("No relevant items in ground truth. Recall is 1.0 by convention."))
                .when(score == 1.0, F.format_string("All %d relevant items were retrieved (perfect recall).", size))
                .when(score == 0.0, F.format_string("None of the %d relevant items were retrieved.", size))
                .otherwise(F.format_string("Found %d of %d relevant items (%d missed). Recall: %.1f%%", hits, size, size - hits, score * 100))
            )
            return result(name, score, threshold, reason=reason, metadata=_retrieval(n, size, F.when(size == 0, F.lit(0)).otherwise(hits)))

        return of(F.when(size == 0, F.lit(1.0)).otherwise(hits.cast("double") / size))

    out = let(_sizes(retrieved, relevant, strategy, hits), told)
    return out if input is None else required(out, name, missing, INPUT=input)


def _sizes(retrieved: Column | str, relevant: Column | str, strategy: Strategy | None, hits: Column | None) -> Column:
    hits = count_matches(retrieved, relevant, strategy or by_equality()) if hits is None else hits
    return F.struct(F.size(_col(retrieved)).alias("n"), F.size(_col(relevant)).alias("size"), hits.alias("hits"))


def _retrieval(retrieved: Column, relevant: Column, hits: Column) -> Column:
    return F.to_json(F.struct(retrieved.alias("retrieved"), relevant.alias("relevant"), hits.alias("truePositives")))


def keyword_coverage(text: Column | str, keywords: list[str], name: str = "Keyword Coverage", threshold: float = 0.5) -> Column:
    """Share of the keywords that the text holds, whatever their case; 1 without keywords."""
    if not keywords:
        return result(name, F.lit(1.0), threshold)
    held = lambda t: sum((F.contains(t, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return let(let(F.lower(_col(text)), held), lambda n: result(name, n.cast("double") / len(keywords), threshold))


def response_length(text: Column | str, low: int, high: int, name: str = "Response Length", threshold: float = 0.5) -> Column:
    """1 if the number of words is within bounds."""
    return let(word_count(text), lambda n: result(name, F.when(n.between(low, high), F.lit(1.0)).otherwise(F.lit(0.0)), threshold, reason=F.format_string("%d words", n)))


Judge = Callable[[list[str]], list[str]]


def asking(judge: Judge):
    """A function from a Column of prompts to the judge's replies, asked in batches; no prompt (null), no reply."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            given = prompts[prompts.notna()]
            yield pd.Series(judge(given.tolist()) if len(given) else [], index=given.index, dtype=object).reindex(prompts.index)

    return ask.asNondeterministic()


def judged(df: DataFrame, prompt: str, reply: str, judge: Judge, concurrency: int | None = None) -> DataFrame:
    """Add the judge's reply to each prompt; ``judge`` gets a batch of prompts. Write the result to a table before using it twice: a judge may answer differently."""
    return (df.repartition(concurrency) if concurrency else df).withColumn(reply, asking(judge)(F.col(prompt)))


def payload(reply: Column | str, schema: str, what: str) -> Column:
    """A judge's JSON, its code fence taken off; anything else stops the query."""
    stop = F.raise_error(F.lit(f"Failed to parse {what}")).cast(schema)
    return let(F.from_json(strip_markdown(reply), schema), lambda parsed: F.coalesce(parsed, stop))


def judge_prompt(criteria: str, parameters: dict[str, Column | str]) -> Column:
    """A prompt from the criteria and the chosen parameters, in order."""
    if not parameters:
        raise ValueError("at least one evaluation parameter is needed")
    parts = [F.concat(F.lit(f"{label}:\n"), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))) for label, c in parameters.items()]
    return F.concat_ws("\n\n", F.lit(f"Criteria:\n{criteria}"), *parts, F.lit('Reply with JSON: {"score": number, "reason": text}'))


def llm_judge(reply: Column | str, name: str, threshold: float = 0.5) -> Column:
    """Score and reason as the judge gave them, not clamped; a reply that is no such JSON is a failure with score 0 and no threshold."""
    c = _col(reply)
    bad = lambda reply: result(name, F.lit(0.0), None, success=F.lit(False), reason=F.concat(F.lit("Failed to parse LLM response: "), F.coalesce(reply, F.lit(""))))
    good = lambda parsed: result(name, parsed["score"], threshold, reason=F.coalesce(parsed["reason"], F.lit("No reason provided.")))
    read = F.struct(F.from_json(strip_markdown(c), "struct<score:double,reason:string>").alias("parsed"), c.alias("reply"))
    return let(read, lambda x: F.when(x["parsed"]["score"].isNull(), bad(x["reply"])).otherwise(good(x["parsed"])))


VERDICTS = "array<struct<verdict:string,reasoning:string,reason:string>>"


def _read(c: Column | str, schema: str, what: str, parsed: bool) -> Column:
    return _col(c) if parsed else payload(c, schema, what)


def faithfulness(claims: Column | str, verdicts: Column | str, name: str = "Faithfulness", threshold: float = 0.8, reason: Column | None = None, parsed: bool = False) -> Column:
    """Share of the claims with verdict yes; 1 without claims. ``parsed``: both are arrays already, as :func:`payload` gives them."""
    yes = F.size(F.filter(_read(verdicts, VERDICTS, "verdicts", parsed), lambda v: F.lower(v["verdict"]) == "yes"))
    counts = F.struct(F.size(_read(claims, "array<string>", "claims", parsed)).alias("n"), yes.alias("yes"), (F.lit(OFF) if reason is None else reason).alias("reason"))
    score = lambda x: F.when(x["n"] == 0, F.lit(1.0)).otherwise(x["yes"].cast("double") / x["n"])
    return let(counts, lambda x: result(name, score(x), threshold, reason=x["reason"]))


def hallucination(verdicts: Column | str, name: str = "Hallucination", threshold: float = 0.5, reason: Column | None = None, parsed: bool = False) -> Column:
    """Share of verdicts no; lower is better: the score must not exceed the threshold, which the result does not carry. ``parsed`` as in :func:`faithfulness`."""
    no = lambda v: F.lower(strip(v["verdict"])) == "no"
    share = lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.filter(x, no)).cast("double") / F.size(x))
    told = lambda x: result(name, x["score"], threshold, success=x["score"] <= threshold, reason=x["reason"], shown=False)
    return let(F.struct(let(_read(verdicts, VERDICTS, "verdicts", parsed), share).alias("score"), (F.lit(OFF) if reason is None else reason).alias("reason")), told)


def context_scores(contexts: Column | str, replies: Column | str) -> Column:
    """Per context chunk its text, clamped score and reason, from the judge's replies; a score that is no number stops the query."""

    def one(context: Column, reply: Column) -> Column:
        def read(parsed: Column) -> Column:
            score = F.coalesce(clamp01(parsed["score"]), F.raise_error(F.lit("relevance score is not a number")).cast("double"))
            return F.struct(context.alias("context"), score.alias("score"), F.coalesce(parsed["reason"], F.lit("No reason provided")).alias("reason"))

        return let(payload(reply, "struct<score:string,reason:string>", "relevance"), read)

    return F.zip_with(_col(contexts), _col(replies), one)


def mean_score(scores: Column) -> Column:
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"]) / F.size(scores))


def contextual_relevance(replies: Column | str, name: str = "ContextualRelevance", threshold: float = 0.5, strict: bool = False, scores: Column | str | None = None, reason: Column | None = None) -> Column:
    """Mean of the clamped scores of an array of replies, one a context chunk; strict mode asks for 1. ``scores``: the replies as read by :func:`context_scores`."""
    scores = context_scores(F.transform(_col(replies), lambda _: F.lit(None).cast("string")), replies) if scores is None else _col(scores)

    def told(x: Column) -> Column:
        n, mean = F.size(x["scores"]), mean_score(x["scores"])
        why = F.format_string("mean relevance %.3f of %d chunks", mean, n) if reason is None else x["reason"]
        why = F.when(n == 0, F.lit("No retrieval context provided to evaluate.")).otherwise(why)
        return result(name, mean, 1.0 if strict else threshold, reason=why, metadata=F.to_json(F.struct(x["scores"].alias("contextScores"))))

    return let(F.struct(scores.alias("scores"), (F.lit(None).cast("string") if reason is None else reason).alias("reason")), told)


def evaluated(df: DataFrame, evaluators: list) -> DataFrame:
    """One row per row and evaluator, in order: evaluator_idx and the result's fields. Evaluators: result Columns, or stages (see ``judges``)."""
    made, given = [], df.columns
    for k, e in enumerate(evaluators):
        if not isinstance(e, Column):
            df, e = e.on(df, f"_stage{k}")
        made.append(e)
    long = df.select("*", F.posexplode(F.array(*made)).alias("evaluator_idx", "_result"))
    return long.select("*", F.col("_result.name").alias("evaluator"), *(f"_result.{c}" for c in ("score", "threshold", "success", "reason")), F.col("_result.metadata").alias("result_metadata")).drop("_result", *(c for c in df.columns if c not in given))
