"""Decontamination and near-duplicates against brute force, and their edge cases."""

import hashlib
import re

import pytest

from assay.llm.decontaminate import contamination, occurrences
from assay.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, lang string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words9(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute9(docs, tests, length):
    windows = {}
    for item, text in tests:
        w = words9(text)
        for i in range(max(1, len(w) - length + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + length]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, items = words9(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if (got := windows.get(tuple(w[i : i + n]))) and i + n <= len(w):
                    hit.update(range(i, i + n))
                    items |= got
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute10(docs, k, percent):
    sets = {}
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def rows(df, order=None):
    return sorted((tuple(r) for r in df.collect()), key=str if order is None else order)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")}


def test_decontamination_equals_brute_force(tables):
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    tests = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    got = rows(contamination(tables["documents"], tables["benchmark"], 10))
    assert got == brute9(docs, tests, 10)
    assert any(r[5] for r in got)


def test_decontamination_edges(spark):
    docs = [(1, None), (2, ""), (3, "Ab cd"), (3, "xx AB, CD yy"), (3, "xx AB, CD yy"), (None, "one two three four"), (5, "é É ab"), (6, "word " * 5000 + "ONE two-three four"), (7, "...")]
    tests = [(1, "ab cd"), (2, "one two three four five"), (3, None), (4, "one two three"), (5, "!!"), (1, "ab cd"), (None, "é")]
    got = rows(contamination(spark.createDataFrame([(a, b, "x") for a, b in docs], SCHEMA), spark.createDataFrame([(a, b, 0) for a, b in tests], "item_id long, text string, doc_id int"), 3))
    want = brute9(docs, [t for t in tests if t[0] is not None], 3)
    want = sorted([(5, 3, 1, 0, hashlib.sha256(b"").hexdigest(), True) if r[0] == 5 else r for r in want], key=str)
    assert got == want
    none = spark.createDataFrame([], SCHEMA)
    assert contamination(none, none.withColumnRenamed("doc_id", "item_id"), 3).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "c a b"), (3, "a q q q q b c")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert [(r.doc_id, r.item_ids) for r in occurrences(docs, tests, 3, slop=1).orderBy("doc_id").collect()] == [(1, ["9"]), (2, ["9"]), (3, [])]
    assert [r.item_ids for r in occurrences(docs, tests, 3).orderBy("doc_id").collect()] == [[], [], []]


def test_near_duplicates_equal_brute_force(tables):
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    assert rows(near_duplicates(tables["documents"], 4, 80), lambda r: r[0]) == brute10(docs, 4, 80)


def test_near_duplicates_of_edited_texts(spark):
    """Chains and cliques around the threshold: the stars alone would not join them all."""
    base = [f"w{i}" for i in range(60)]
    docs = []
    for g in range(4):
        for v in range(30):
            w = [f"{x}g{g}" for x in base]
            for e in range(1 + v % 3):
                w[(7 * v + 13 * e) % 60] = f"edit{g}-{v}-{e}"
            docs.append((len(docs), " ".join(w), "x"))
    assert rows(near_duplicates(spark.createDataFrame(docs, SCHEMA), 4, 80), lambda r: r[0]) == brute10([d[:2] for d in docs], 4, 80)


def test_near_duplicates_edges(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "ONE  two", "x"), (9, "long " * 30000, "x"), (8, "long " * 20000, "x"), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (None, "a b c d e", "x")]
    got = rows(near_duplicates(spark.createDataFrame(docs, SCHEMA), 4, 80))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (9, 1, 8, False), (8, 1, 8, True), (7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
