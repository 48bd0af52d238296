"""The sieve keeps every row that has a partner and rules out nearly all others."""

from assay.llm.scratch import Scratch
from assay.llm.sieve import sieved


def test_splits_rows(spark):
    rows = spark.createDataFrame([(i, i % 3, "x") for i in range(5000)] + [(None, 1, "y")], "doc_id long, bits int, part string")
    keys = spark.createDataFrame([(i,) for i in range(0, 5000, 10)], "doc_id long")
    maybe, no = sieved(rows, "doc_id", keys, Scratch(spark, "sieve"), "bits")
    held = [r.doc_id for r in maybe.collect()]
    assert set(range(0, 5000, 10)) <= set(held) and len(held) < 510
    assert maybe.columns == no.columns == rows.columns and len(held) + no.count() == 5001
    maybe, no = sieved(rows, "doc_id", spark.createDataFrame([(None,)], "doc_id long"), Scratch(spark, "sieve"), "bits")
    assert [r.part for r in maybe.collect() if r.doc_id is None] == ["y"]
    maybe, no = sieved(rows, "doc_id", keys.limit(0), Scratch(spark, "sieve"), "bits")
    assert maybe.count() == 0 and no.count() == 5001
