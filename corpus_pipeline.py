"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's result as Parquet in the folder
that all executors share, and hands it on as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate as leaks
from assay.llm import minhash, packing, substrings, toxicity
from assay.llm.scratch import Scratch
from assay.llm.sieve import sieved

LABELS, BENCHMARK = "labels", "benchmark"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects.

    Null and empty texts get the score of the bias, which is below 0.5 as long as toxic texts are the fewer: they stay. Repeated rows
    are judged alike; a null doc_id is judged by its text. Without toxic labels nothing goes. Empty table: no rows.
    """
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/{LABELS}.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) keep the document with the smallest doc_id.

    Null and empty texts are in no group and stay. Rows that repeat a doc_id stay or go together; a null doc_id goes if its
    text is in a group with another. Empty table: no rows.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80)
    # a doc_id goes if none of its rows is kept
    gone = found.groupBy("doc_id").agg(F.bool_or(F.expr("kept or doc_id is null and component_id is null")).alias("stays")).where("not stays").select("doc_id")
    return _without(docs, gone, "minhash")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out the bytes of strings of 100 bytes that occur earlier; a document of which nothing is left goes.

    n_chars is that of the text left; characters that a cut has broken are left out. Null and empty texts stay as they are. Rows that repeat both
    doc_id and text are one document and cut alike; a null doc_id comes before all others. Empty table: no rows.
    """
    scratch = Scratch(spark, "cut")
    found = substrings.remove_repeats(docs, length=100).where("n_removed > 0").select("doc_id", "th", "kept_text").distinct()
    found = scratch.save(found, "cut")
    maybe, no = sieved(docs, "doc_id", found, scratch, "cut-ids")
    same = F.expr("d.doc_id <=> c.doc_id and c.th in (0, xxhash64(d.text))")  # th is 0 where doc_ids do not repeat
    joined = maybe.alias("d").join(found.alias("c").hint("merge"), same, "left").where("c.kept_text is null or c.kept_text <> ''")
    text = F.coalesce(F.col("c.kept_text"), F.col("d.text"))
    made = {"text": text.alias("text")} | {f.name: F.length(text).cast(f.dataType).alias(f.name) for f in docs.schema if f.name == "n_chars"}
    return no.union(joined.select(*(made.get(c, F.col(f"d.`{c}`")) for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts stay. Rows that repeat a doc_id go together if one of them is hit. Empty table or no benchmark: nothing goes.
    """
    found = leaks.contamination(docs, spark.read.parquet(f"{sf_dir}/{BENCHMARK}.parquet"), length=10)
    return _without(docs, found.where("contaminated").select("doc_id").distinct(), "leaked")


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``gone``; only rows whose doc_id may be there are moved."""
    scratch = Scratch(docs.sparkSession, name)
    gone = scratch.save(gone, "gone")
    maybe, no = sieved(docs, "doc_id", gone, scratch, "gone-ids")
    return no.union(maybe.alias("d").join(gone.alias("g").hint("merge"), F.expr("d.doc_id <=> g.doc_id"), "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    Null and empty texts are their closing token alone; rows that repeat a doc_id are packed each; a null doc_id is kept. Empty table: no rows.
    """
    return packing.pack(docs, window=2048)


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash", keep_one_of_each_group),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # learned scores and token ids are not SQL; tests compare stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each stage's table goes once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
