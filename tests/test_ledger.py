import datetime

from pyspark.sql import functions as F

from parlance.operators import ledger
from parlance.streaming import jobs

NOW = datetime.datetime(2024, 5, 10, 12)
HOUR = datetime.timedelta(hours=1)
OWN = "batch_id string, status string, output_file_id string, submitted_at timestamp, collected boolean, error string"
REMOTE = "batch_id string, status string, output_file_id string, created_at timestamp"


def test_transitions_are_applied_once(spark):
    own = [("a", "validating", None, NOW, False, None), ("b", "in_progress", None, NOW, False, None), ("c", "in_progress", None, NOW, False, None), ("d", "completed", "f", NOW, True, None), ("e", "in_progress", None, NOW, None, None), ("gone", "in_progress", None, NOW, False, None)]
    listed = [
        ("a", "in_progress", None, NOW), ("b", "completed", "out", NOW), ("c", "expired", None, NOW), ("d", "completed", "f", NOW), ("e", "in_progress", None, NOW),
        ("new", "finalizing", None, NOW - 99 * HOUR), ("done", "completed", "g", NOW - 47 * HOUR), ("done", "in_progress", None, NOW - 48 * HOUR), ("old", "completed", "h", NOW - 49 * HOUR), ("bad", "failed", None, NOW - HOUR), ("empty", "completed", None, NOW), (None, "failed", None, NOW),
    ]
    before, remote = spark.createDataFrame(own, OWN), spark.createDataFrame(listed, REMOTE)
    found = ledger.transitions(before, remote, str(NOW))
    assert {r["batch_id"]: r["action"] for r in found.collect()} == {"a": "update", "b": "ingest", "c": "resolve", "new": "adopt", "done": "ingest", "bad": "resolve", "empty": "resolve"}
    after = ledger.applied(before, found)
    rows = {r["batch_id"]: (r["status"], r["collected"], r["error"]) for r in after.collect()}
    assert rows["a"] == ("in_progress", False, None) and rows["b"] == ("completed", True, None) and rows["c"] == ("expired", True, "expired") and rows["bad"] == ("failed", True, "failed")
    assert rows["gone"] == ("in_progress", False, None) and len(rows) == 10 and "old" not in rows
    assert ledger.transitions(after, remote, str(NOW)).count() == 0
    articles = [(1, "in_progress", "a", 1), (2, "in_progress", "b", 1), (3, "in_progress", None, 3), (4, "in_progress", "c", None), (5, "completed", "b", 1), (6, "in_progress", "nowhere", 2)]
    freed = ledger.free_orphans(spark.createDataFrame(articles, "id long, status string, batch_id string, attempts int"), after)
    assert {r["id"]: (r["status"], r["batch_id"]) for r in freed.collect()} == {1: ("in_progress", "a"), 2: ("unanalyzed", None), 3: ("failed", None), 4: ("unanalyzed", None), 5: ("completed", "b"), 6: ("unanalyzed", None)}


def test_limited_ingest_over_restarts(spark, tmp_path):
    def land(k):
        spark.createDataFrame([(k * 10 + i, "x" if i % 2 else "y") for i in range(10)], "id long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(limit):
        rows = spark.readStream.schema("id long, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return sorted(r["id"] for r in jobs.ingest_matched(rows, F.col("kind") == "x", "id", limit, str(tmp_path / "out"), str(tmp_path / "check")).collect())

    land(0)
    assert run(12) == [1, 3, 5, 7, 9]
    land(1)
    assert run(12) == list(range(1, 20, 2))
    land(2)
    land(3)
    taken = run(12)
    assert taken[:10] == list(range(1, 20, 2)) and len(taken) == 12 and len(set(taken)) == 12
    assert run(12) == taken
