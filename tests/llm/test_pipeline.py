"""The corpus pipeline: each stage against brute force on what the stage before it kept."""

import numpy as np
import pytest

import corpus_pipeline as cp
from assay.llm import toxicity

from .test_op4 import checked
from .test_op9_op10 import brute9, brute10

SF = "/root/testdata/sf0.001"


def brute_cut(docs, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if kept or not gone.any():
            out[doc_id] = text if not gone.any() else kept
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "minhash", "suffix_array", "decontamination", "packing"] and cp.ORACLE_SQL is None


def test_toxic_documents_go(spark, stages):
    scored = toxicity.score(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(texts(stages[1])) == {r.doc_id for r in scored if r.predicted == 0}
    assert len(texts(stages[1])) > 0.7 * len(scored)


def test_one_of_each_group_stays(stages):
    want = {r[0] for r in brute10(list(texts(stages[1]).items()), 5, 80) if r[3]}
    assert set(texts(stages[2])) == want


def test_repeats_are_cut(stages):
    want = brute_cut(list(texts(stages[2]).items()))
    assert texts(stages[3]) == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_leaked_documents_go(spark, stages):
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in brute9(list(texts(stages[3]).items()), tests, 10) if not r[5]}
    assert set(texts(stages[4])) == want


def test_what_is_left_is_packed(stages):
    checked(stages[5].collect(), list(texts(stages[4]).items()))
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_run(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r.length for r in cp.run(spark, SF).select(key).collect()) == sum(r.length for r in stages[5].collect())


def test_stages_take_nulls_and_clashing_columns(spark):
    names = "kept string, th int, kept_id long, cut_id long, cut_th long, kept_text string, leaked_id long, component_id long, bits string, part int"
    rest = (4, 5, 6, "t", 7, 8, "b", 9)
    docs = [(1, None, None, 1, *rest), (None, "some text here", "en", 2, *rest), (2, "", None, 3, *rest), (2, "", None, 3, *rest), (3, "x " * 5000, "en", None, *rest), (4, "x " * 5000 + "y", "en", None, *rest)]
    docs = spark.createDataFrame(docs, f"doc_id long, text string, {names}")
    for name, stage in cp.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {1, None, 2, 3, 4}
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []
