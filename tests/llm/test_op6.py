"""Repeated substrings against brute force, the suffix sort itself, and edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from assay.llm import substrings
from assay.llm.substrings import Suffixes, remove_repeats

SCHEMA = "doc_id long, text string, th string"


def brute(docs, length):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert result(remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def collided(length, seed, anchored=substrings._anchored):
    """Anchors with contexts that the first two hash functions confuse."""
    inner = anchored(length, seed)

    def run(it):
        for b in inner(it):
            ctx = pa.array(b.column("ctx").to_numpy() % (1 if seed < 2 else 1 << 62))
            yield pa.RecordBatch.from_arrays([b.column("gram"), ctx, *b.columns[2:]], names=b.schema.names)

    return run


@pytest.mark.parametrize("how", ["plain", "short runs", "collisions"])
def test_equals_brute_force_on_spliced_texts(spark, monkeypatch, how):
    """Overlaps, self-repeats, chains of different contexts; also sorted in short runs, and with contexts whose hashes collide."""
    if how == "short runs":
        monkeypatch.setattr(substrings, "RUN", 3)
    if how == "collisions":
        monkeypatch.setattr(substrings, "_anchored", collided)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9))), "x") for i in range(60)]
    docs += [(60, "ab" * 400, "x"), (61, "z" * 99, "x"), (62, "z" * 100, "x"), (63, "z" * 350, "x"), (64, None, "x"), (65, "", "x")]
    assert result(remove_repeats(spark.createDataFrame(docs, SCHEMA))) == brute([d[:2] for d in docs], 100)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    docs = [(1, body, "x"), (2, "q" * 50 + body[11_000:29_000] + "r" * 50, "x")]
    monkeypatch.setattr(substrings, "PIECE", 1 << 12)
    place = {p for _, lo, hi, b in substrings._pieces(np.array([0, 40_000]), 100) for p in substrings.anchors(np.frombuffer(body.encode(), np.uint8), lo, hi, b, 100)[0] + lo}
    monkeypatch.undo()
    whole = substrings.anchors(np.frombuffer(body.encode(), np.uint8), 0, 40_000, np.array([0, 40_000]), 100)[0]
    assert place == set(whole)
    assert result(remove_repeats(spark.createDataFrame(docs, SCHEMA))) == brute([d[:2] for d in docs], 100)


def test_suffix_sort_orders_bytes_inside_groups():
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(500)]
    group = np.sort(np.array([rng.randint(0, 20) for _ in keys]))
    offsets = np.append(0, np.cumsum([len(k) for k in keys]))
    s = Suffixes(np.frombuffer(b"".join(keys), np.uint8), offsets, group)
    assert [(group[i], keys[i]) for i in s.order] == sorted((g, k) for g, k in zip(group, keys, strict=True))
    for n in range(13):
        c = s.classes(n)
        for i in range(0, 499):
            j = i + 1
            assert (c[i] == c[j] and c[i] >= 0) == (group[i] == group[j] and len(keys[i]) >= n and len(keys[j]) >= n and keys[i][:n] == keys[j][:n]) or c[i] == c[j] == -1


def test_edges(spark):
    p = "p" * 60 + "x" * 60
    docs = [(2, p, "a"), (2, p, "b"), (2, "q" * 200 + p, "c"), (None, p, "d"), (9, p[:99], "e")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got[0] == ("2", 120, 120, 1) and got[1] == ("2", 120, 120, 1)
    assert got[2][0:2] == ("2", 320) and got[2][2] >= 120 and got[3] == ("9", 99, 0, 0) and got[4] == ("None", 120, 0, 0)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_collisions_without_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_anchored", collided)
    monkeypatch.setattr(substrings, "SEEDS", 2)
    docs = [(k, "ab cd" * 30 + chr(97 + k) * 120, "x") for k in range(5)]
    with pytest.raises(RuntimeError, match="collide"):
        remove_repeats(spark.createDataFrame(docs, SCHEMA))


def test_a_common_line_between_different_texts(spark, monkeypatch):
    """One line in many texts: its anchors have as many contexts as texts, in several runs."""
    monkeypatch.setattr(substrings, "RUN", 7)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    docs = [(i, text() + line + text(), "x") for i in range(60)]
    got = result(remove_repeats(spark.createDataFrame(docs, SCHEMA)))
    assert got == brute([d[:2] for d in docs], 100) and sum(r[2] > 0 for r in got) == 59
