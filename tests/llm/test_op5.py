"""WARC: round trip, framing, digests, and damaged archives."""

import glob
import gzip
import hashlib
import io
import random

import pytest

from assay.llm import warc

SCHEMA = "page_id long, url string, html string, record_type int"


def want(pages, least):
    best = {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= least:
            best[b] = max(best.get(b, -1), -1 if p is None else p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= least and best[b] != (-1 if p is None else p)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(warc.round_trip(pages)) == want(rows, 1000)


def test_edges(spark):
    big = "é<p>" * 400
    pages = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "WARC/1.1\r\n\r\n"), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "y" * 300_000), (2, "u", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], SCHEMA)
    assert got(warc.round_trip(df)) == want(pages, 1000)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame([(i, f"http://h/{i}", "z" * i, 0) for i in range(50)], SCHEMA)
    warc.write(df, folder, 1000)
    back = warc.read(spark, folder, payload=True).collect()
    assert {r.record_id: bytes(r.payload) for r in back} == {f"<urn:page:{i}:{hashlib.sha1(b'z' * i).hexdigest()}>": b"z" * i for i in range(50)}
    assert all(r.valid for r in back)


def test_archives_are_plain_gzip_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Whole members whatever their length's last byte is; several rows a file and several files a task."""
    monkeypatch.setattr(warc, "ROWS", 2)
    rng = random.Random(2)
    pages = [(i, "u", "".join(chr(rng.randint(33, 0x2FF)) for _ in range(1 << 20)), 0) for i in range(9)] + [(9, "u", "a" * (17 << 20), 0)]
    folder = f"{tmp_path}/archives"
    warc.write(spark.createDataFrame(pages, SCHEMA).repartition(1), f"file://{folder}", 1 << 30, 1)
    files = [gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{folder}/part-*")]
    assert sum(f.count(b"WARC/1.1\r\n") for f in files) == 10 and len(files) > 1
    assert sorted(r.payload_bytes for r in warc.read(spark, f"file://{folder}").collect()) == sorted(len(h.encode()) for _, _, h, _ in pages)


def made(page, payload, refers=None):
    return warc.record(page, "u", None if refers else payload, len(payload), hashlib.sha1(payload).hexdigest(), refers)


def test_members_are_plain_gzip():
    a, b = made(1, b"one" * 50_000), made(2, b"two", 1)
    data = warc.member(a) + warc.member(b"") + warc.member(b)
    assert gzip.decompress(data) == a + b
    first, second = warc.records(io.BytesIO(data), payload=True)
    assert first["payload"] == b"one" * 50_000 and first["valid"]
    digest = hashlib.sha1(b"two").hexdigest()
    assert (second["record_type"], second["refers_to"], second["payload_bytes"], second["payload_digest"]) == ("revisit", f"<urn:page:1:{digest}>", 3, digest)
    assert made(2, b"two", 1) != b  # revisits have ids of their own


def test_damage_is_told():
    good = made(1, b"payload")
    assert [r["valid"] for r in warc.records(io.BytesIO(warc.member(good.replace(b"payload", b"paylaod"))))] == [False]
    for bad in (warc.member(good)[:-9], warc.member(good[:-1]), warc.member(good + b"x"), warc.member(b"HTTP" + good), b"not gzip", warc.member(good.replace(b"response\r\nContent-Length: ", b"response\r\nContent-Length: 9"))):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


def test_a_url_of_megabytes(spark):
    rows = spark.createDataFrame([(1, "http://a.b/" + "x/" * 1_500_000, "<p>long</p>")], "page_id long, url string, html string")
    assert [tuple(r)[:2] for r in warc.round_trip(rows).collect()] == [(1, 11)]
