"""Packing: exact cover of every document's ids, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm.packing import Encoder, combinations, pack, plan, repeats, tokenizer_path

SCHEMA = "doc_id long, text string, start long"


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def checked(rows, docs, window=2048):
    ids = {d: v for (d, _), v in zip(docs, encoded([t for _, t in docs]), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [*((v, len(ids[d])) for d, v in by_doc.items()), *((v, None) for v in by_sequence.values())]:
        end = 0
        for a, n in sorted(pieces):
            assert a == end
            end += n
        assert end == total if total else end <= window
    assert set(by_doc) == set(ids)
    total = sum(map(len, ids.values()))
    assert len(by_sequence) * window - total < window, "only the last sequence may be padded"


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    checked(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 30_000), (5, " \n\t x   y  z"), (None, "null id"), *((10 + i, "same length") for i in range(3000))]
    checked(pack(spark.createDataFrame([(a, b, 7) for a, b in docs], SCHEMA)).collect(), docs)
    twice = pack(spark.createDataFrame([(1, "a b", 0), (1, "a b", 0)], SCHEMA)).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdé1!<|>endofx"))))
def test_ids_equal_the_tokenizer_library(text):
    assert [*next(ENCODER.ids([text])), 1] == encoded([text])[0]


ENCODER = Encoder(tokenizer_path())


def test_encoder_is_the_fast_one():
    assert ENCODER.fast is not None and ENCODER.width is np.uint16


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_uses_no_tail_twice(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    slots, taken, used = plan(h, 64)
    assert (taken <= h).all() and used == len({s for _, a, b, q, _ in slots for s in range(q, q + b - a)})
    assert taken.sum() > 0.5 * h.sum()
    columns = combinations(h, 64)
    assert all(sum(c) == 64 for c in columns) and (repeats(h, columns) >= 0).all()
