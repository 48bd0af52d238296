"""The reporter's stream: storing, flushing, gathering by count or time, delivery and rollups."""

import collections
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from assay.plans import tracking
from assay.streaming import delivery as dl
from assay.streaming import reporter as rp
from assay.streaming.rollup import Rollup


def item(run, k, good=True, evals=True):
    return (run, k, f"i{k}", "", good, 1.0, [("E", 1.0, None, good, "")] if evals else None)


def items(spark, rows=None):
    return spark.createDataFrame(rows or [item("r", k) for k in range(23)] + [item("s", 0, evals=False)], rp.SCHEMA)


def until(what, seconds=30):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if found := what():
            return found
        time.sleep(0.1)
    raise AssertionError(f"not in time: {what()}")


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("an answer that cannot be read is tried again")

    assert dl.retried(flaky, backoff=0) == (True, 3, None)
    ok, tried, error = dl.retried(lambda: (_ for _ in ()).throw(dl.Refused("no")), backoff=0)
    assert (ok, tried) == (False, 1) and "no" in error
    assert dl.retried(lambda: (_ for _ in ()).throw(OSError("down")), backoff=0)[:2] == (False, 3)
    assert rp.local_handle().startswith("local-")


def test_requests_hold_ten(spark):
    got = sorted((r.run_id, r.request, r.n) for r in rp.requests(items(spark)).collect())
    assert got == [("r", 0, 10), ("r", 1, 10), ("r", 2, 3), ("s", 0, 1)]
    sent = {r.key: (r.run_id, r.n, r.body) for r in rp.bodies(items(spark)).collect()}
    assert len(sent) == 4 and all(dl.key_of(run, body) == key and len(json.loads(body)["items"]) == n for key, (run, n, body) in sent.items())


def test_flush_waits_until_all_is_stored(spark, tmp_path):
    """What was reported before a flush is found right after it, every time."""
    (tmp_path / "in").mkdir()
    query = rp.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    reporter = rp.FolderReporter(spark, str(tmp_path / "in"), query=query, target=str(tmp_path / "out"))
    try:
        for k in range(12):
            reporter.send(items(spark, [item(f"r{k}", 0), item(f"r{k}", 1, False), item("again", 0)]))
            assert reporter.flush()
            found = {(r.run_id, r.item_idx) for r in rp.stored(spark, str(tmp_path / "out")).collect()}
            assert found == {(f"r{j}", i) for j in range(k + 1) for i in (0, 1)} | {("again", 0)}
        reporter.send(items(spark, [item("z", 0)]).where("false"))
        assert reporter.flush() and rp.flush(query)
        counts = {r.run_id: (r.total, r.passed) for r in Rollup(spark, f"{tmp_path}/out-rollup").read().collect()}
        assert counts == {f"r{k}": (2, 1) for k in range(12)} | {"again": (1, 1)}
    finally:
        reporter.close()
    reporter.send(items(spark, [item("late", 0)]))
    assert not reporter.flush(1)  # the stream has ended
    with pytest.warns(UserWarning, match="in time"):
        reporter.complete_run("late", "SUCCESS")


def test_flush_is_bounded(spark, tmp_path):
    reporter = rp.FolderReporter(spark, str(tmp_path / "in"), target=str(tmp_path / "out"))
    reporter.send(items(spark))
    began = time.monotonic()
    assert not reporter.flush(0.5) and time.monotonic() - began < 5
    rp.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert reporter.flush(0.5) and rp.stored(spark, str(tmp_path / "out")).count() == 24


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    """Items that are reported again, and a batch whose commit was lost, leave items, rollup and receipts as they were."""
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: rp.start(spark, source, target, cp, once=True, files_per_batch=1).awaitTermination()
    for k in range(4):
        items(spark, [item("r", j, j % 3 > 0) for j in range(k * 5, k * 5 + 8)] + [item(f"q{k}", 0)]).coalesce(1).write.mode("append").json(source)
    run()
    want = {"r": (23, 15)} | {f"q{k}": (1, 1) for k in range(4)}
    counts = lambda: {r.run_id: (r.total, r.passed) for r in Rollup(spark, f"{target}-rollup").read().collect()}
    assert counts() == want and rp.stored(spark, target).count() == 27
    last = max(int(f) for f in os.listdir(f"{cp}/commits") if f.isdigit())
    os.remove(f"{cp}/commits/{last}")  # as if the driver had died before it
    for f in os.listdir(f"{cp}/commits"):
        if str(last) in f and f.endswith(".crc"):
            os.remove(f"{cp}/commits/{f}")
    run()
    assert counts() == want and rp.stored(spark, target).count() == 27
    assert sum(r.n for r in rp.received(spark, target).collect()) == 36


def test_a_large_batch_is_handed_over_small_and_held_nowhere(spark, tmp_path, monkeypatch):
    """Reported items are compressed; a batch is not persisted, and is dealt to partitions of bounded size."""
    from pyspark.sql import DataFrame

    from assay import shared

    monkeypatch.setattr(DataFrame, "persist", lambda *a: pytest.fail("a batch is persisted"))
    monkeypatch.setattr(rp, "dealt", lambda df, *keys, each, large: shared.dealt(df, *keys, each=20, large=large))
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    reporter = rp.FolderReporter(spark, source, target=target)
    for k in range(2):
        reporter.send(items(spark, [item("r", j, j % 3 > 0) for j in range(k * 500, k * 500 + 800)] * 2))
        rp.start(spark, source, target, cp, once=True).awaitTermination()
        assert reporter.flush(1)
    files = [f for f in os.listdir(source) if f.startswith("part-")]
    assert all(f.endswith(".json.gz") for f in files) and sum(os.path.getsize(f"{source}/{f}") for f in files) < 3200 * 20
    assert len([f for f in os.listdir(f"{target}/batch=0") if f.startswith("part-")]) > 8
    assert {(r.run_id, r.total, r.passed) for r in Rollup(spark, f"{target}-rollup").read().collect()} == {("r", 1300, 866)}
    got = rp.stored(spark, target)
    assert got.count() == got.select("item_idx").distinct().count() == 1300 and sum(r.n for r in rp.received(spark, target).collect()) == 3200


def test_a_batch_of_new_items_is_parsed_once_and_stored_as_it_came(spark, tmp_path, monkeypatch):
    """Rows are dealt and sorted only where an item occurs twice; a table without its mark does not count."""
    from pyspark.sql import DataFrame

    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    reporter = rp.FolderReporter(spark, source, target=target)
    run = lambda: rp.start(spark, source, target, cp, once=True).awaitTermination()
    found = lambda: sorted((r.run_id, r.item_idx) for r in rp.stored(spark, target).collect())
    counts = lambda: {r.run_id: (r.total, r.passed) for r in Rollup(spark, f"{target}-rollup").read().collect()}
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "dropDuplicates", lambda *a: pytest.fail("new items are sorted"))
        reporter.send(items(spark, [item("r", j, j % 3 > 0) for j in range(30)]))
        run()
        assert reporter.flush(1) and found() == [("r", j) for j in range(30)] and counts() == {"r": (30, 20)}
        reporter.send(items(spark, [item("r", j, j % 3 > 0) for j in range(20, 40)]))  # ten of them again
        run()
        assert reporter.flush(1) and found() == [("r", j) for j in range(40)] and counts() == {"r": (40, 26)}
    reporter.send(items(spark, [item("r", j) for j in (39, 40, 40)] + [item("s", 0)] * 2))
    run()
    assert reporter.flush(1) and found() == [("r", j) for j in range(41)] + [("s", 0)] and counts() == {"r": (41, 27), "s": (1, 1)}
    assert [f for f in sorted(os.listdir(target)) if "=" in f] == ["batch=1", "batch=2", "whole=0"]
    os.remove(f"{target}/whole=0/_SUCCESS")  # as if the driver had died before it
    assert ("r", 0) not in found() and len(found()) == 12


def test_rows_are_dealt_in_full_waves_and_repeats_are_told(spark):
    from assay import shared

    rows = spark.range(2000, numPartitions=1).selectExpr("id % 1990 id", "cast(id as string) s")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert [shared.dealt(rows, "id", each=size // n, least=4).rdd.getNumPartitions() for n in (1, 4, 5, 9)] == [4, 4, 8, 12]
    assert shared.repeats(rows, "id") and not shared.repeats(rows, "id", "s") and not shared.repeats(rows.where("false"), "id")


def test_rollup_casts_its_key_before_it_groups(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert dict(rollup.read(key="long").dtypes)["run_id"] == "bigint"
    rollup.add(items(spark, [item("1", 0), item("1", 1, False), item("12", 0)]), 0)
    assert {(r.run_id, r.total, r.passed) for r in rollup.read(key="long").collect()} == {(1, 2, 1), (12, 1, 1)}


def test_rollup_folds_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("assay.streaming.rollup.FOLD", 3)
    rollup, want = Rollup(spark, str(tmp_path / "r")), collections.Counter()
    assert rollup.read().collect() == []
    for k in range(9):
        rows = [item(f"r{j % 3}", k * 10 + j, j != 2) for j in range(k + 1)]
        rollup.add(items(spark, rows), k)
        rollup.add(items(spark, rows), k)  # tried again
        want.update(f"r{j % 3}" for j in range(k + 1))
        assert {r.run_id: r.total for r in rollup.read().collect()} == dict(want)
    assert len(rollup._parts(None)) <= 4 and len(os.listdir(tmp_path / "r")) < 9
    spans = {r.run_id: (r.first_batch, r.last_batch) for r in rollup.read().collect()}
    assert spans == {"r0": (0, 8), "r1": (1, 8), "r2": (2, 8)}
    before = {r.run_id: r.total for r in rollup.read(before=8).collect()}
    assert before == {"r0": 12, "r1": 9, "r2": 7} or sum(before.values()) == 36


def test_queries_read_the_rollup_and_no_evaluation(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.add(items(spark, [item("a", 0), item("a", 1, False), item("b", 0)]), 0)
    runs = spark.createDataFrame([("a", "e", "SUCCESS", 1), ("b", "e", "RUNNING", 2), ("c", "f", "FAILED", 1)], "run_id string, experiment_id string, status string, started_at long")
    experiments = spark.createDataFrame([("e", 1), ("f", 2)], "experiment_id string, created_at long")
    broken = spark.range(1).select(F.raise_error(F.lit("read")).alias("run_id"))
    s = tracking.Store(None, experiments, runs, broken, broken, rollup.read())
    assert {r.run_id: r.pass_rate for r in tracking.trends(s).collect()} == {"a": 0.5, "c": 0.0}
    assert {r.experiment_id: (r.run_id, r.pass_rate) for r in tracking.list_experiments(s).collect()} == {"e": ("b", None), "f": ("c", None)}
    assert {r.run_id: (r.total, r.passed) for r in tracking.list_runs(s).collect()} == {"a": (2, 1), "b": (1, 1), "c": (0, 0)}


def kept(folder, fail=None):
    """A receiver that writes a file a request, and counts the calls that it got for each."""

    def receive(run, body, key):
        if fail:
            fail(run, body, key)
        with open(os.path.join(folder, key), "a") as f:
            f.write(json.dumps([run, body]) + "\n")

    return receive


def calls(folder):
    """(run, item numbers) of each call."""
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            out += [(run, [i["item_idx"] for i in json.loads(body)["items"]]) for run, body in map(json.loads, f)]
    return sorted(out)


def test_requests_of_ten_across_batches_and_the_rest_by_time(spark, tmp_path):
    source, got = str(tmp_path / "in"), str(tmp_path / "got")
    os.mkdir(got)
    items(spark, [item("r", k) for k in range(4)] + [item("s", 0)]).coalesce(1).write.json(source)
    box = dl.Outbox(spark, str(tmp_path / "box"), kept(got))
    query = box.start(rp.reported_items(spark, source), str(tmp_path / "cp"), wait_ms=45_000)
    until(lambda: query.lastProgress and query.lastProgress["batchId"] >= 1)
    assert calls(got) == []  # four of ten wait
    items(spark, [item("r", k) for k in range(4, 12)]).coalesce(1).write.mode("append").json(source)
    until(lambda: len(calls(got)) == 1)
    assert calls(got) == [("r", list(range(10)))]  # from two batches
    done = query.lastProgress["batchId"]
    until(lambda: query.lastProgress["batchId"] > done + 1)
    query.stop()
    query.awaitTermination(10)  # a restart loses none of those that wait, with nothing new
    query = dl.Outbox(spark, str(tmp_path / "box"), kept(got)).start(rp.reported_items(spark, source), str(tmp_path / "cp"), wait_ms=45_000)
    until(lambda: len(calls(got)) >= 3 or (not query.isActive and query.exception()), 150)
    query.stop()
    query.awaitTermination(10)
    assert calls(got) == [("r", list(range(10))), ("r", [10, 11]), ("s", [0])]
    assert sorted((r.run_id, r.n, r.state) for r in box.ledger().collect()) == [("r", 2, "sent"), ("r", 10, "sent"), ("s", 1, "sent")]


def test_each_request_once_though_a_worker_and_the_stream_fail(spark, tmp_path):
    """A worker dies in the middle of a batch; the batch is tried again after a restart; what is refused is dropped, on record."""
    source, got, died = str(tmp_path / "in"), str(tmp_path / "got"), str(tmp_path / "died")
    os.mkdir(got)
    rows = [item(f"r{k}", j) for k in range(12) for j in range(10)] + [item("bad", j) for j in range(10)] + [item("down", j) for j in range(10)]
    items(spark, rows).coalesce(1).write.json(source)

    def fail(run, body, key):
        if run == "bad":
            raise dl.Refused("four hundred")
        if run == "down":
            raise OSError("five hundred")
        if len(os.listdir(got)) >= 5 and not os.path.exists(died):
            open(died, "w").close()
            os._exit(1)

    make = lambda: dl.Outbox(spark, str(tmp_path / "box"), kept(got, fail), backoff=0.01).start(rp.reported_items(spark, source), str(tmp_path / "cp"))
    query = make()
    until(lambda: not query.isActive)
    assert os.path.exists(died) and 5 <= len(calls(got)) < 12
    query = make()
    box = dl.Outbox(spark, str(tmp_path / "box"), None)
    until(lambda: box.ledger().count() == 14)
    query.stop()
    query.awaitTermination(10)
    assert calls(got) == sorted((f"r{k}", list(range(10))) for k in range(12))  # no request twice
    told = {r.run_id: (r.state, r.attempts, r.error) for r in box.ledger().where("state = 'dropped'").collect()}
    assert told["bad"][:2] == ("dropped", 1) and "four hundred" in told["bad"][2] and told["down"][:2] == ("dropped", 3)
    assert not os.path.exists(tmp_path / "box/marks/batch=0")
    box.deliver(spark.createDataFrame([("new", "k", 1, "{}")], dl.REQUEST), 0)  # what a batch held is final
    assert box.ledger().count() == 14


def test_requests_of_a_stored_batch(spark, tmp_path):
    got = str(tmp_path / "got")
    os.mkdir(got)
    items(spark).write.json(str(tmp_path / "in"))
    rp.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True, receiver=kept(got)).awaitTermination()
    ledger = dl.Outbox(spark, str(tmp_path / "out-requests"), None).ledger()
    assert sorted((r.run_id, r.n, r.state) for r in ledger.collect()) == [("r", 3, "sent"), ("r", 10, "sent"), ("r", 10, "sent"), ("s", 1, "sent")]
    assert sorted(k for _, ks in calls(got) for k in ks) == sorted([*range(23), 0])
