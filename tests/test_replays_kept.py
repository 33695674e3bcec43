"""Replays told by the events that are written: exactly once, null keys and far apart copies; and a query whose parts take many tasks."""

import glob
import os

from pyspark.sql import functions as F

from rankpulse.plans import text_queries
from rankpulse.streaming import streams

EVENTS = "event_id long, ts timestamp, user_id long"


def test_written_events_are_the_state(spark, tmp_path):
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))

    def run(*data):
        if data:
            rows = spark.createDataFrame([(k, day, u) for k, day, u in data], "event_id long, day string, user_id long")
            rows.select("event_id", F.col("day").cast("timestamp").alias("ts"), "user_id").repartition(3).write.mode("append").parquet(source)
        return streams.dedupe_kept(streams.read_events(spark, source, EVENTS), ["event_id"], kept, checkpoint, EVENTS, "2 days")

    found = lambda: sorted(((r.event_id, str(r.ts)[5:10], r.user_id) for r in spark.read.schema(EVENTS).parquet(kept).collect()), key=str)
    # in one batch the first of a key stays
    progress = run((1, "2026-01-01", 1), (2, "2026-01-02", 2), (2, "2026-01-03", 3), (None, "2026-01-03", 4))
    # 2 is within two days of the one before, 1 isn't, a null key is one more copy, 3 is new
    progress += run((2, "2026-01-04", 5), (1, "2026-01-04", 6), (None, "2026-01-04", 7), (3, "2026-01-05", 8))
    want = sorted([(1, "01-01", 1), (2, "01-02", 2), (None, "01-03", 4), (1, "01-04", 6), (3, "01-05", 8)], key=str)
    assert found() == want
    assert len(progress) == 2 and not any(p["stateOperators"] for p in progress)
    # a batch that is repeated, as after a failure before its commit, changes nothing
    for f in glob.glob(f"{checkpoint}/commits/*1*") + glob.glob(f"{checkpoint}/commits/.1*"):
        os.remove(f)
    assert len(run()) == 1 and found() == want


def test_parts_come_in_many_files(spark, sf, tmp_path, monkeypatch):
    """The four parts of a table of eight files are written by several tasks each (four at least read the files), and each is one batch."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    folders, batches = [], []
    read, available = streams.read_events, streams.run_available
    monkeypatch.setattr(streams, "read_events", lambda s, folder, *a, **k: folders.append(folder) or read(s, folder, *a, **k))
    monkeypatch.setattr(streams, "run_available", lambda *a, **k: batches.extend(available(*a, **k)) or batches)
    out = text_queries.stream_replays(spark, str(tmp_path))
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(set(folders)) == 1 and len(glob.glob(f"{folders[0]}/part-*")) > 8
    assert sum(p["numInputRows"] > 0 for p in batches) == 4


def test_arriving_parts_keep_their_tasks(spark, tmp_path):
    """The other streams' parts are written by the tasks that have their rows, not by one."""
    part = spark.range(400).selectExpr("id as event_id", "timestamp'2026-01-01' as ts", "id as user_id").repartition(4)
    text_queries._arrive(part, str(tmp_path / "source"))
    assert len(glob.glob(f"{tmp_path}/source/part-*")) == 4
