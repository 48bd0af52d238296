"""A judge's replies as a table: each different prompt is asked once, and a run that was stopped goes on where it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.log import Log
from ..shared import Scratch, exists
from ..shipping import ship

SCHEMA = "key string, reply string"
WAVES = 64  # at most, of one asking


class Replies:
    """Replies kept in ``path``; takes the place of ``judge`` in the judge-based evaluators.

    What is missing is asked in waves of about ``every`` prompts, or of a 64th if that is more, by ``concurrency`` tasks, each wave written as it comes: a judge that
    fails, or a driver that dies, loses one wave at most. Two who ask at once may both ask the same prompt; one of the replies is kept for all. The judge of :class:`LlmRetrieval` is asked
    directly, as what it is asked next depends on its last reply.
    """

    def __init__(self, spark: SparkSession, path: str, judge: Callable[[list[str]], list[str]], every: int = 1000, concurrency: int | None = None):
        self.spark, self.judge, self.every, self.concurrency = spark, judge, every, concurrency
        self.log = Log(spark, path, SCHEMA, lambda rows: rows.groupBy("key").agg(F.min("reply").alias("reply")))
        self.waves = 0
        self.told: Scratch | None = None

    def __call__(self, prompts: list[str]) -> list[str]:
        return self.judge(prompts)

    def __reduce__(self):
        return _plain, (self.judge,)  # tasks get the judge alone

    def ask(self, prompts: DataFrame) -> None:
        """Ask what has no reply yet of a column ``prompt``; nulls are no prompts."""
        ship(self.spark)
        scratch = Scratch(self.spark, "prompts")
        wanted = prompts.where("prompt is not null").select(_key(F.col("prompt")).alias("key"), "prompt").dropDuplicates(["key"])
        missing = scratch.save(wanted.join(self.log.state().select("key"), "key", "left_anti"), "missing")
        waves = min(WAVES, -(-missing.count() // self.every))
        if waves > 1:  # each wave reads its own folder
            wave, seat = F.pmod(F.xxhash64("key"), F.lit(waves)), F.pmod(F.crc32("key"), F.lit(self.spark.sparkContext.defaultParallelism))
            missing.withColumn("wave", wave).repartition("wave", seat).write.partitionBy("wave").parquet(f"{scratch.path}/waves")
        judge = self.judge

        def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"key": pdf["key"], "reply": pd.Series(judge(pdf["prompt"].tolist()), index=pdf.index, dtype=object)})

        for wave in range(waves):
            folder = f"{scratch.path}/waves/wave={wave}"
            if waves > 1 and not exists(self.spark, folder):  # no key falls into it
                continue
            part = self.spark.read.schema(missing.schema).parquet(folder) if waves > 1 else missing
            self.log.append((part.repartition(self.concurrency) if self.concurrency else part).mapInPandas(answered, SCHEMA))
            self.waves += 1
            if self.waves % 32 == 0:
                self.log.fold()
        scratch.close()

    def _told(self, keys: DataFrame) -> DataFrame:
        """The replies of these keys, written once: later folds delete the files that the log's state is read from now."""
        self.told = self.told or Scratch(self.spark, "replies-told")
        return self.told.save(self.log.state().join(keys, "key", "left_semi"), uuid.uuid4().hex)

    def on(self, df: DataFrame, name: str, prompt: Column) -> DataFrame:
        """``df`` with a column of replies; those that are missing are asked now."""
        key = f"_{uuid.uuid4().hex}"
        self.ask(df.select(prompt.alias("prompt")))
        replies = self._told(df.select(_key(prompt).alias("key"))).select(F.col("key").alias(key), F.col("reply").alias(name))
        return df.drop(name).join(replies, _key(prompt) == F.col(key), "left").drop(key)

    def on_each(self, df: DataFrame, name: str, prompts: Column) -> DataFrame:
        """``df`` with a column of lists of replies, one for each prompt of a list."""
        key = f"_{uuid.uuid4().hex}"
        of = _key(F.to_json(prompts))
        lists = df.select(of.alias(key), prompts.alias("prompts")).where("prompts is not null").dropDuplicates([key]).select(key, F.posexplode_outer("prompts").alias("pos", "prompt"))
        self.ask(lists.select("prompt"))
        told = lists.withColumn("key", _key(F.col("prompt"))).join(self._told(lists.select(_key(F.col("prompt")).alias("key"))), "key", "left").groupBy(key)
        each = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "reply"))))
        told = told.agg(F.transform(each, lambda x: x["reply"]).alias(name))
        return df.drop(name).join(told.withColumnRenamed(key, f"{key}k"), of == F.col(f"{key}k"), "left").drop(f"{key}k")


def _plain(judge):
    return judge


def _key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)
