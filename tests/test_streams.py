"""Streams with state: it survives a restart, stays bounded, and late rows touch their own days only."""

import datetime
import os

from pyspark.sql import functions as F

from rankpulse.streaming import streams

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime.datetime(2026, 1, 1)


def rows(days, per_day=3, first_id=0):
    return [(first_id + 10 * d + k, START + datetime.timedelta(days=d, hours=k), 10 * d + k, "a" if k % 2 else "b", float(d)) for d in days for k in range(per_day)]


def arrive(spark, folder, data):
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_replays_and_bounded_state(spark, tmp_path):
    """Copies within the delay go, also after a restart; the state holds the rows of the last days and not all."""
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    progress = []
    for first in (0, 20, 40, 60):
        days = range(first, first + 20)
        arrive(spark, source, rows(days) + (rows([first - 1]) if first else []))
        stream = streams.dedupe(streams.read_events(spark, source, EVENTS, files=1), ["event_id"], "2 days")
        progress += streams.keep_changes(stream, kept, checkpoint, "append")
    found = [r.event_id for r in spark.read.parquet(kept).collect()]
    assert sorted(found) == sorted(r[0] for r in rows(range(80)))
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert len(found) == 240 and held[-1] < 80
    assert any("rocksdb" in k.lower() for s in progress[-1]["stateOperators"] for k in s["customMetrics"])


def test_panel_state(spark, tmp_path):
    """The panel of a stream that is stopped and goes on is that of the batch; months merge from days; sketches are near many users."""
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    for days in (range(0, 15), range(14, 40)):  # a day in both files
        arrive(spark, source, rows(days, first_id=0 if days[0] == 0 else 1000))
        streams.keep_changes(streams.panel_state(streams.read_events(spark, source, EVENTS, files=1)), kept, checkpoint)
    state = streams.latest(spark, kept, ["day", "event_type"], "day date, event_type string, n_events long, total double, n_values long, users binary")
    events = spark.read.schema(EVENTS).parquet(source)
    want = {(r.day, r.event_type): (r.n_events, r.n_users, r.mean_value) for r in streams.daily_panel(events, exact=True).collect()}
    assert {(r.day, r.event_type): (r.n_events, r.n_users, r.mean_value) for r in streams.merge_panels(state).collect()} == want
    months = {(r.day.month, r.event_type): (r.n_events, r.n_users) for r in streams.merge_panels(state, "month").collect()}
    direct = events.groupBy(F.month("ts").alias("m"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u")).collect()
    assert months == {(r.m, r.event_type): (r.n, r.u) for r in direct}
    many = spark.range(100_000).select(F.lit(START).alias("ts"), F.lit("a").alias("event_type"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"))
    two = streams.panel_state(many.filter("user_id < 60000")).unionByName(streams.panel_state(many.filter("user_id >= 40000")))
    assert abs(streams.merge_panels(two).first().n_users - 100_000) < 3_000


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_late_days(spark, tmp_path):
    """Rows that are late by few days are taken in and their days alone written anew; older ones are in quarantine; a repeated batch changes nothing."""
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    run = lambda: streams.late_days(streams.read_events(spark, source, EVENTS, files=1), kept, checkpoint, EVENTS, 5)
    arrive(spark, source, rows(range(20)))
    run()
    before = files(f"{kept}/panel")
    late = rows([17], first_id=5000) + rows([3], first_id=6000)
    arrive(spark, source, late)
    run()
    after = files(f"{kept}/panel")
    changed = {p.split("day=")[1][:10] for p in before.keys() ^ after.keys()} | {p.split("day=")[1][:10] for p in before.keys() & after.keys() if before[p] != after[p]}
    assert changed == {"2026-01-18"}
    panel = {(str(r.day), r.event_type): r.n_events for r in spark.read.parquet(f"{kept}/panel").collect()}
    assert panel["2026-01-18", "b"] == 4 and panel["2026-01-04", "b"] == 2
    assert sorted(r.event_id for r in spark.read.schema(EVENTS).parquet(f"{kept}/quarantine").collect()) == sorted(r[0] for r in late if r[0] >= 6000)
    assert spark.read.parquet(f"{kept}/rows").count() == 63
