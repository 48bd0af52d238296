"""Append-only tracking tables: one row an update, writers at the same time, snapshots."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from assay.plans import tracking
from assay.plans.log import Tracker
from assay.shared import children, create, read_text

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(hours=k)


def statuses(tracker):
    return {r.run_id: (r.status, r.completed_at) for r in tracker.runs().collect()}


def test_an_update_is_one_row_and_the_last_counts(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    assert t.runs().collect() == t.projects().collect() == []
    t.begin(spark.createDataFrame([(f"r{k}", "e", at(k)) for k in range(200)], "run_id string, experiment_id string, started_at timestamp"))
    t.update("r3", "FAILED")
    new = [e for e in children(spark, f"{tmp_path}/runs/events")]
    assert sorted(spark.read.parquet(f"{tmp_path}/runs/events/{e}").count() for e in new) == [1, 200]
    got = {r.run_id: r for r in t.runs().collect()}
    assert len(got) == 200 and got["r3"].status == "FAILED" and got["r3"].completed_at is not None and got["r3"].started_at == at(3) and got["r4"].completed_at is None
    changes = lambda *rows: t.set_status(spark.createDataFrame(rows, "run_id string, status string, at timestamp"))
    changes(("r5", "SUCCESS", at(500)), ("r6", "CANCELLED", at(500)))
    changes(("r5", "RUNNING", at(501)), ("r6", "SUCCESS", at(499)), ("unknown", "SUCCESS", at(1)))  # no guard against going back; a late message does not win
    got = statuses(t)
    assert got["r5"] == ("RUNNING", None) and got["r6"] == ("CANCELLED", at(500)) and "unknown" not in got


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both update and fold at once, many times; every update is there in the end, and each name has one project."""
    one = Tracker(spark, str(tmp_path))
    one.begin(spark.createDataFrame([(f"{w}{k}", "e") for w in "ab" for k in range(6)], "run_id string, experiment_id string"))
    failed = []

    def write(w):
        try:
            t = Tracker(spark, str(tmp_path))
            for k in range(6):
                t.update(f"{w}{k}", "SUCCESS")
                if k % 2:
                    t.fold()
                t.project(spark.createDataFrame([("shared",), (w,)], "name string"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed
    assert {s for s, _ in statuses(one).values()} == {"SUCCESS"} and len(statuses(one)) == 12
    assert sorted(r.name for r in one.projects().collect()) == ["a", "b", "shared"]


def test_folds_keep_the_state_and_few_files(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    t.begin(spark.createDataFrame([("r", "e")], "run_id string, experiment_id string"))
    for k in range(5):
        t.update("r", f"S{k}")
        assert t.fold() and statuses(t)["r"][0] == f"S{k}"
    assert len(children(spark, f"{tmp_path}/runs/events")) <= 2 and len(children(spark, f"{tmp_path}/runs/snapshots")) == len(children(spark, f"{tmp_path}/runs/commits")) == 2


def test_of_two_folds_of_one_state_one_is_committed(spark, tmp_path, monkeypatch):
    a, b = Tracker(spark, str(tmp_path)), Tracker(spark, str(tmp_path))
    a.begin(spark.createDataFrame([("r", "e")], "run_id string, experiment_id string"))
    seen = b._runs._snapshot()
    assert a._runs.fold()
    a.update("r", "SUCCESS")
    monkeypatch.setattr(b._runs, "_snapshot", lambda: seen)  # it looked before the other committed
    assert not b._runs.fold()
    assert statuses(a)["r"][0] == "SUCCESS" and len(children(spark, f"{tmp_path}/runs/snapshots")) == 1


def test_files_are_made_once(spark, tmp_path):
    path = f"{tmp_path}/c/1"
    assert create(spark, path, "first é") and not create(spark, path, "second")
    assert read_text(spark, path) == "first é" and children(spark, f"{tmp_path}/c") == ["1"] and children(spark, f"{tmp_path}/none") == []


def test_the_queries_read_the_log(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    t.project(spark.createDataFrame([("P",)], "name string"))
    p = t.projects().first()
    t.experiment(spark.createDataFrame([(p.project_id, "E"), (p.project_id, "E")], "project_id string, name string"))
    t.experiment(t.projects().select("project_id", F.lit("E").alias("name")))
    e = t.experiments().collect()
    assert len(e) == 1
    t.begin(spark.createDataFrame([("r", e[0].experiment_id)], "run_id string, experiment_id string"))
    none = spark.createDataFrame([], "run_id string, item_id string, success boolean")
    s = tracking.Store(t.projects(), t.experiments(), t.runs(), none, none)
    assert [(r.name, r.status, r.pass_rate) for r in tracking.list_experiments(s).collect()] == [("E", "RUNNING", None)]
