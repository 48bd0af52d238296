"""The driver's tables as a tracking store and as evaluation inputs.

nation: projects; customer: experiments; orders: runs; lineitem: an item per (order, line number) and an evaluation per row;
events: an experiment of five runs; conversations: questions and answers; documents, benchmark, embeddings: outputs to evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tracking import Store
from ..shared import dealt

STATUS = "case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'FAILED' else 'RUNNING' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("name"), F.lit(0).cast("timestamp").alias("created_at"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_name").alias("name"), F.col("c_custkey").cast("timestamp").alias("created_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), F.expr(STATUS).alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of lineitem, dealt by run: what is grouped, ranked or joined by run and more needs no other shuffle."""
    return dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", *columns), "l_orderkey")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation per lineitem row; its number inside an item follows the row's own values."""
    rows = lines(spark, sf_dir, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_returnflag")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1
    score = F.col("l_discount") * 10
    return rows.select(
        item_id().alias("item_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("item_idx"), nth.alias("evaluator_idx"), F.col("l_returnflag").alias("evaluator"),
        score.alias("score"), F.lit(0.5).alias("threshold"), (score >= 0.5).alias("success"),
    )


def plain_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`evals` without numbers inside an item, for queries that do not ask for order."""
    score = F.col("l_discount") * 10
    return lines(spark, sf_dir, "l_linenumber", "l_discount", "l_returnflag").select(item_id().alias("item_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("item_idx"), F.col("l_returnflag").alias("evaluator"), score.alias("score"), (score >= 0.5).alias("success"))


def item_id():
    return F.col("l_orderkey") * 100 + F.col("l_linenumber")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "l_linenumber").select(item_id().alias("item_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("item_idx")).distinct()


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(projects(spark, sf_dir), experiments(spark, sf_dir), runs(spark, sf_dir), items(spark, sf_dir), plain_evals(spark, sf_dir))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of one experiment in five runs: ten items, evaluators by event type, repeats counted."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("run_index"), (F.col("event_id") % 10).alias("item_idx"), F.col("event_id").alias("evaluator_idx"), F.col("event_type").alias("evaluator"), F.col("value").alias("score"),
        F.when(F.col("event_id") % 3 == 0, F.lit(50.0)).alias("threshold"), (F.col("value") >= 50).alias("success"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("event_type")).alias("reason"),
    )


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's turn that comes next."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(turn), "next": F.lead("role").over(turn)})
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), F.col("answer").alias("actual_output"))
