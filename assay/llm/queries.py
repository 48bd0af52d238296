"""One query per operator of this subpackage, with its production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), window=2048)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), least=1000)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    return compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judged

    return judged(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least=30, top=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_language_id, op2_quality, op3_licences, op4_packing, op5_warc, op6_suffix_array, op7_nn_descent, op8_toxicity, op9_positional_index, op10_minhash, op11_codes, op12_url_rules, op13_divergence, pipeline)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return SQL
