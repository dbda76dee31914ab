"""Delayed outcomes: a stream of predictions meets a stream of closings."""

import datetime as dt

import pytest

from roadwatch.streaming import replay

START = dt.datetime(2024, 3, 1, 8)
COLUMNS = "id bigint, event_cause string, priority string, requires_road_closure boolean, start_datetime timestamp"


@pytest.fixture
def world(spark, tmp_path):
    """Folders, and functions that add events and closings and take one step of the log."""
    paths = {n: str(tmp_path / n) for n in ("events", "ends", "out", "state")}

    def at(hours):
        return START + dt.timedelta(hours=hours)

    def add(events, ends):
        rows = [(i, "accident", "Low", False, at(h)) for i, h in events]
        spark.createDataFrame(rows, COLUMNS).write.mode("append").parquet(paths["events"])
        replay.publish_closings(spark.createDataFrame([(i, at(h)) for i, h in ends], "id bigint, closed_datetime timestamp"), paths["ends"])

    def step():
        log = replay.outcome_log(spark.readStream.schema(COLUMNS).parquet(paths["events"]), replay.closing_source(spark, paths["ends"]))
        replay.run_to_end(log, paths["out"], paths["state"])
        rows = [(r.incident_id, r.actual_duration) for r in spark.read.parquet(paths["out"]).collect()]
        assert len(dict(rows)) == len(rows)   # never twice
        return {i: d for i, d in rows if i >= 0}

    return add, step


def test_late_missing_and_repeated_closings(spark, world):
    add, step = world
    add([(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (9, 2)], [(1, 3), (1, 3), (3, -2), (4, 26), (77, 5)])
    assert step() == {1: 3.0}                        # 2 waits, 3 closed before it began, 4 beyond its wait
    add([(6, 20)], [(2, 20), (1, 4), (6, 21)])
    assert step() == {1: 3.0, 2: 20.0, 6: 1.0}       # a second closing of 1 changes nothing
    add([(-1, 50)], [(-2, 50)])
    expected = {1: 3.0, 2: 20.0, 3: None, 4: None, 5: None, 6: 1.0, 9: None}
    assert step() == expected                        # the waiting time is over
    add([], [(9, 4)])
    assert step() == expected                        # too late: logged already


def test_markers_end_both_feeds(spark, sf, tmp_path):
    feed = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events, ends, out, state = (str(tmp_path / n) for n in ("events", "ends", "out", "state"))
    replay.publish_feed(feed, events)
    rows = replay.incidents_from_feed(feed)
    replay.publish_closings(rows, ends)
    replay.close_outcomes(spark, events, ends)
    replay.run_to_end(replay.outcome_log(replay.replay_source(spark, events), replay.closing_source(spark, ends)), out, state)
    got = spark.read.parquet(out)
    assert got.count() == feed.count() == got.select("incident_id").distinct().count()
    known = rows.filter("closed_datetime <= start_datetime + INTERVAL 24 HOURS").count()
    assert got.filter("actual_duration IS NOT NULL").count() == known > 0
