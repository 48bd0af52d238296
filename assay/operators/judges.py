"""Judge-based evaluators as stages: each adds the judge's replies to a frame, prompt by prompt in batches, and scores them as Columns.

A stage has ``on(df, at)``, which returns the frame with its replies (columns that begin with ``at``) and the result Column. The
frame has columns input, actual_output and the context; a judge is a function from a list of prompts to as many replies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvaluationError
from ..functions.scalar import java_list, relevance_bucket, says_yes, strip, strip_markdown
from . import evaluators as ev
from .evaluators import Judge
from .replies import Replies


def replied(df: DataFrame, name: str, prompt: Column, judge: Judge) -> DataFrame:
    """``df`` with a column of replies: of a judge as the plan runs, or of a table of replies that asks what it lacks now."""
    return judge.on(df, name, prompt) if isinstance(judge, Replies) else df.withColumn(name, ev.asking(judge)(prompt))


def _context(df: DataFrame, name: str, metric: str) -> Column:
    """The context as one text; a list is shown as ``[a, b]``; without it the evaluation stops."""
    if name not in df.columns:
        raise EvaluationError(f"{metric} requires '{name}' in actualOutputs")
    value = java_list(name) if isinstance(df.schema[name].dataType, T.ArrayType) else F.col(name).cast("string")
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{metric} requires '{name}' in actualOutputs")).cast("string")).otherwise(value)


def _prompt(text: str, **values: Column) -> Column:
    """The text with ``{name}`` replaced by values; null where one of them is."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def _joined(items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(F.lit("None"))


@dataclass
class Faithfulness:
    """Share of the answer's claims that the context's truths support: truths, claims and verdicts are asked for, then a summary."""

    judge: Judge
    name: str = "Faithfulness"
    threshold: float = 0.8
    context: str = "context"
    include_reason: bool = True
    missing: str = "raise"

    def on(self, df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        there = F.col("input").isNotNull() & F.col("actual_output").isNotNull()
        only = lambda c: F.when(there, c)
        df = replied(df, f"{at}_truths", only(_prompt("List the facts that the context states, as a JSON array of texts and nothing else.\n\nContext: {context}", context=_context(df, self.context, self.name))), self.judge)
        df = replied(df, f"{at}_claims", only(_prompt("Split the answer into its single claims. Reply with a JSON array of texts and nothing else.\n\nAnswer: {answer}", answer=F.col("actual_output"))), self.judge)
        for c in ("truths", "claims"):  # read once
            df = df.withColumn(f"{at}_{c}", only(ev.payload(F.col(f"{at}_{c}"), "array<string>", c)))
        texts = lambda c: java_list(F.col(f"{at}_{c}"))
        df = replied(df, f"{at}_verdicts", only(_prompt(
            'Say for each claim whether the truths support it. Reply with a JSON array and nothing else: [{open}"verdict": "Yes", "No" or "IDK", "reasoning": text{close}]\n\nTruths: {truths}\nClaims: {claims}',
            truths=texts("truths"), claims=texts("claims"), open=F.lit("{"), close=F.lit("}"),
        )), self.judge)
        df = df.withColumn(f"{at}_verdicts", only(ev.payload(F.col(f"{at}_verdicts"), ev.VERDICTS, "verdicts")))
        reason = None
        if self.include_reason:
            verdicts = F.col(f"{at}_verdicts")
            told = F.array_join(F.transform(verdicts, lambda v: F.concat_ws(": ", v["verdict"], v["reasoning"])), "; ")
            df = replied(df, f"{at}_reason", F.when(there & (F.size(verdicts) > 0), _prompt("Sum up in one sentence how faithful the answer is, above all why claims were not supported.\n\nVerdicts: {verdicts}", verdicts=told)), self.judge)
            reason = F.when(F.size(verdicts) == 0, F.lit("No claims were found to evaluate.")).otherwise(strip(f"{at}_reason"))
        out = ev.faithfulness(F.col(f"{at}_claims"), F.col(f"{at}_verdicts"), self.name, self.threshold, reason, parsed=True)
        return df, ev.required(out, self.name, self.missing, INPUT="input", ACTUAL_OUTPUT="actual_output")


@dataclass
class Hallucination:
    """Share of the answer's statements that the context does not support; lower is better, and the result carries no threshold."""

    judge: Judge
    name: str = "Hallucination"
    threshold: float = 0.5
    context: str = "context"
    include_reason: bool = True
    missing: str = "raise"

    def on(self, df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        there = F.col("input").isNotNull() & F.col("actual_output").isNotNull()
        prompt = _prompt(
            'Split the answer into statements and say of each whether the context supports it. Reply with a JSON array and nothing else: [{open}"verdict": "yes" or "no", "reason": text{close}]\n\nContext: {context}\n\nAnswer: {answer}',
            context=_context(df, self.context, self.name), answer=F.col("actual_output"), open=F.lit("{"), close=F.lit("}"),
        )
        df = replied(df, f"{at}_verdicts", F.when(there, prompt), self.judge)
        df = df.withColumn(f"{at}_verdicts", F.when(there, ev.payload(F.col(f"{at}_verdicts"), ev.VERDICTS, "verdicts")))
        reason = None
        if self.include_reason:
            verdicts = F.col(f"{at}_verdicts")
            yes = lambda v: F.lower(strip(v["verdict"])) == "yes"
            reasons = lambda keep: _joined(F.transform(F.filter(verdicts, keep), lambda v: F.coalesce(v["reason"], F.lit("null"))), "; ")
            score = ev.hallucination(verdicts, parsed=True)["score"]
            prompt = _prompt("Sum up in one sentence how far the answer is invented, above all why.\n\nSupported: {good}\nNot supported: {bad}\nScore: {score}", good=reasons(yes), bad=reasons(lambda v: ~yes(v)), score=F.format_string("%.2f", score))
            df = replied(df, f"{at}_reason", F.when(there & (F.size(verdicts) > 0), prompt), self.judge)
            reason = F.when(F.size(verdicts) == 0, F.lit("No statements were found to evaluate.")).otherwise(strip(f"{at}_reason"))
        out = ev.hallucination(F.col(f"{at}_verdicts"), self.name, self.threshold, reason, parsed=True)
        return df, ev.required(out, self.name, self.missing, INPUT="input", ACTUAL_OUTPUT="actual_output")


@dataclass
class ContextualRelevance:
    """Mean relevance of the retrieved chunks (a list of texts, or one text) to the question; a score for each chunk is in the metadata."""

    judge: Judge
    name: str = "ContextualRelevance"
    threshold: float = 0.5
    context: str = "retrievalContext"
    strict: bool = False
    include_reason: bool = True
    missing: str = "raise"

    def on(self, df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        _context(df, self.context, self.name)
        kind = df.schema[self.context].dataType
        if not isinstance(kind, T.StringType) and not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)):
            raise EvaluationError(f"Expected '{self.context}' to be a list of texts or a text, but got: {kind.simpleString()}")
        given = F.array(self.context) if isinstance(kind, T.StringType) else F.col(self.context)
        stop = F.raise_error(F.lit(f"{self.name} requires '{self.context}' in actualOutputs")).cast("array<string>")
        df = df.withColumn(f"{at}_chunks", F.when(F.col(self.context).isNull(), stop).otherwise(given))
        prompts = F.transform(f"{at}_chunks", lambda c: _prompt(
            'Say how relevant the context is to the question, from 0 (not at all) to 1 (answers it). Reply with JSON and nothing else: {open}"score": number, "reason": text{close}\n\nQuestion: {input}\n\nContext: {chunk}',
            input=F.coalesce(F.col("input"), F.lit("null")), chunk=F.coalesce(c, F.lit("null")), open=F.lit("{"), close=F.lit("}"),
        ))
        prompts = F.when(F.col("input").isNotNull(), prompts)
        df = self.judge.on_each(df, f"{at}_replies", prompts) if isinstance(self.judge, Replies) else df.withColumn(f"{at}_replies", asking_each(self.judge)(prompts))
        df = df.withColumn(f"{at}_scores", F.when(F.col("input").isNotNull(), ev.context_scores(F.col(f"{at}_chunks"), F.col(f"{at}_replies"))))  # read once
        reason = None
        if self.include_reason:
            scores = F.col(f"{at}_scores")
            numbered = F.transform(scores, lambda s, i: F.struct(F.format_string("Context %d (score: %.2f)", i + 1, s["score"]).alias("shown"), relevance_bucket(s["score"]).alias("bucket")))
            named = lambda b: _joined(F.transform(F.filter(numbered, lambda x: x["bucket"] == b), lambda x: x["shown"]), ", ")
            each = F.array_join(F.transform(scores, lambda s, i: F.format_string("Context %d: score=%.2f, reason=%s", i + 1, s["score"], s["reason"])), "\n")
            prompt = _prompt(
                "Sum up in one sentence how relevant the contexts are.\n\nQuestion: {input}\nMean: {mean}\nContexts: {n}\nHighly relevant: {high}\nPartially relevant: {partial}\nIrrelevant: {none}\n\n{each}",
                input=F.col("input"), mean=F.format_string("%.3f", ev.mean_score(scores)), n=F.size(scores), high=named("high"), partial=named("partial"), none=named("irrelevant"), each=each,
            )
            df = replied(df, f"{at}_reason", F.when(F.size(scores) > 0, prompt), self.judge)
            reason = strip(f"{at}_reason")
        out = ev.contextual_relevance(F.col(f"{at}_replies"), self.name, self.threshold, self.strict, F.col(f"{at}_scores"), F.lit(ev.OFF) if reason is None else reason)
        return df, ev.required(out, self.name, self.missing, INPUT="input")


@dataclass
class LlmJudge:
    """A score and reason by criteria over chosen parameters: a label each, and the column that holds it."""

    judge: Judge
    name: str
    criteria: str
    parameters: dict[str, str] = field(default_factory=lambda: {"INPUT": "input", "ACTUAL_OUTPUT": "actual_output"})
    threshold: float = 0.5
    missing: str = "raise"

    def on(self, df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        df = replied(df, f"{at}_reply", ev.judge_prompt(self.criteria, dict(self.parameters)), self.judge)
        return df, ev.required(ev.llm_judge(f"{at}_reply", self.name, self.threshold), self.name, self.missing, **self.parameters)


@dataclass
class LlmRetrieval:
    """Precision (or recall) whose matches a judge decides: each retrieved item against the expected ones in order, until one matches."""

    judge: Judge
    retrieved: str = "retrieved"
    relevant: str = "relevant"
    of: Callable[..., Column] = ev.precision
    name: str = "Precision"
    threshold: float = 0.5

    def on(self, df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        texts = lambda c: F.col(c).cast("array<string>")
        df = df.withColumn(f"{at}_said", matching(self.judge)(texts(self.retrieved), texts(self.relevant)))
        hits = F.size(F.filter(f"{at}_said", lambda said: says_yes(strip_markdown(said))))
        return df, self.of(self.retrieved, self.relevant, name=self.name, threshold=self.threshold, hits=hits)


def asking_each(judge: Judge):
    """A function from a Column of lists of prompts to lists of replies; all prompts of a batch of rows are asked at once."""

    @F.pandas_udf("array<string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            given = lists[lists.notna()]
            flat = [p for prompts in given for p in prompts]
            replies = iter(judge(flat) if flat else [])
            yield pd.Series([[next(replies) for _ in prompts] for prompts in given], index=given.index, dtype=object).reindex(lists.index)

    return ask.asNondeterministic()


def matching(judge: Judge):
    """A function from Columns of retrieved and of expected items to the deciding reply about each retrieved one: the first yes, or the last."""
    prompt = "Do these two items say the same or name the same thing? Reply with yes or no and nothing else.\n\nRetrieved: {}\n\nExpected: {}"

    @F.pandas_udf("array<string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for retrieved, relevant in batches:
            pairs = list(zip(retrieved, relevant, strict=True))
            said: dict[tuple, str] = {}
            left = [(row, k, 0) for row, (r, e) in enumerate(pairs) if r is not None and e is not None for k in range(len(r))]
            while left := [(row, k, n) for row, k, n in left if n < len(pairs[row][1])]:
                for (row, k, n), reply in zip(left, judge([prompt.format(pairs[row][0][k], pairs[row][1][n]) for row, k, n in left]), strict=True):
                    said[row, k] = reply
                left = [(row, k, n + 1) for row, k, n in left if not _yes(said[row, k])]
            yield pd.Series([None if r is None else [said.get((row, k)) for k in range(len(r))] for row, (r, _) in enumerate(pairs)], dtype=object)

    return ask.asNondeterministic()


def _yes(reply: str | None) -> bool:
    return (reply or "").strip().removeprefix("```json").strip("`").strip().lower().startswith("yes")


def qa_presets(judge: Judge, criteria: str, context: str = "context") -> list:
    """The question-answering preset: faithfulness, hallucination, answer quality by ``criteria``, and contextual relevance, with their thresholds."""
    return [
        Faithfulness(judge, threshold=0.8, context=context), Hallucination(judge, threshold=0.2, context=context),
        LlmJudge(judge, "Answer Quality", criteria, threshold=0.7), ContextualRelevance(judge, threshold=0.6, context=context),
    ]
