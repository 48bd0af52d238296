"""Adapters: functions of single texts as judges and tasks of an experiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvaluationError
from ..operators.evaluators import Judge

Task = Callable[[DataFrame], DataFrame]


def judge_of(model: Callable[[str], str | None]) -> Judge:
    """A judge from a model that takes one prompt; a prompt or an answer that is null is an error."""

    def judge(prompts: list[str]) -> list[str]:
        replies = []
        for p in prompts:
            reply = None if p is None else model(p)
            if reply is None:
                raise EvaluationError("the judge was given no prompt" if p is None else "the judge's answer is empty")
            replies.append(reply)
        return replies

    return judge


def simple_task(model: Callable[[str], str], input: str = "input", output: str = "actual_output") -> Task:
    """A task that gives each input to a model, in batches on the executors."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model, na_action="ignore")

    return lambda df: df.withColumn(output, answer.asNondeterministic()(F.col(input)))


def rag_task(model: Callable[[str], tuple[str, list[str]]], input: str = "input", output: str = "actual_output", context: str = "context") -> Task:
    """A task whose model answers with a text and the texts that it has retrieved."""

    @F.pandas_udf("output string, context array<string>")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [(None, None) if t is None else model(t) for t in texts]
            yield pd.DataFrame({"output": [g[0] for g in got], "context": [g[1] for g in got]}, index=texts.index)

    def task(df: DataFrame) -> DataFrame:
        out = df.withColumn("_answer", answer.asNondeterministic()(F.col(input)))
        return out.withColumns({output: F.col("_answer.output"), context: F.col("_answer.context")}).drop("_answer")

    return task


def custom_task(outputs: Callable[[dict], dict[str, str]], keys: list[str]) -> Task:
    """A task that answers an example's inputs with a text under each of ``keys``; the key ``output`` becomes actual_output."""

    @F.pandas_udf("map<string,string>")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for inputs in batches:
            yield inputs.map(lambda m: dict(outputs(dict(m))))

    def task(df: DataFrame) -> DataFrame:
        out = df.withColumn("_answers", answer.asNondeterministic()(F.col("inputs")))
        return out.withColumns({"actual_output" if k == "output" else k: F.try_element_at("_answers", F.lit(k)) for k in keys}).drop("_answers")

    return task
