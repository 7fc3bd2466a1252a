import datetime

import numpy as np
import pytest

from parlance.streaming import jobs, leases

DAY = datetime.datetime(2024, 1, 1)
SPAN = datetime.timedelta(hours=6)


def replay(events, watermark):
    """The rows of a plain walk over each key's events."""
    out = []
    for user in sorted({e[2] for e in events}):
        begun, failed, history = None, 0, []
        for _, ts, _, kind in sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])) + [(None, watermark + datetime.timedelta(milliseconds=1), user, "end of time")]:
            if begun is not None and (ts - begun > SPAN or kind == "end of time" and begun + SPAN <= watermark):
                failed += 1
                out.append((user, "retired" if failed == 3 else "reset", begun + SPAN, failed, tuple(history)))
                begun = None
            if kind == "click" and begun is None and failed < 3:
                begun = ts
                history.append(ts)
            elif kind == "purchase" and begun is not None:
                out.append((user, "completed", ts, failed + 1, tuple(history)))
                begun, failed, history = None, 0, []
    return sorted(out)


def rows_of(frame):
    return sorted((r["user_id"], r["status"], r["at"], r["attempts"], tuple(r["begun"])) for r in frame.collect())


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield leases.with_rocksdb(spark)
    spark.conf.set(key, before)


def test_against_a_replay_over_restarts(rocks, tmp_path):
    spark = rocks
    rng = np.random.default_rng(0)
    kinds = ["click", "click", "click", "purchase", "view"]
    events = sorted((int(i), DAY + datetime.timedelta(minutes=int(rng.integers(0, 6 * 1440))), int(rng.integers(0, 12)), str(rng.choice(kinds))) for i in range(250))
    events += [(900, DAY, 50, "click"), (901, DAY + SPAN, 50, "purchase"), (902, DAY, 51, "click"), (903, DAY + SPAN * 2, 51, "click"), (904, DAY + SPAN * 4, 51, "click"), (905, DAY + SPAN * 6, 51, "click"), (906, DAY + SPAN * 6, 51, "purchase")]
    events.sort(key=lambda e: e[1])
    cuts = [0, 90, 170, len(events)]  # three landings, in order of time
    for k in range(3):
        part = events[cuts[k] : cuts[k + 1]]
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
        found = jobs.run_to_table(leases.lease_attempts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    watermark = max(e[1] for e in events) - datetime.timedelta(hours=1)
    got = rows_of(found)
    assert got == replay(events, watermark)
    assert {r[1] for r in got} == {"completed", "reset", "retired"}
    assert (51, "retired", DAY + SPAN * 5, 3, (DAY, DAY + SPAN * 2, DAY + SPAN * 4)) in got
