"""Incremental versions of ingest, dedupe and panels on event streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpulse.operators import panelstate
from rankpulse.operators.upsert import empty_tables, newest, save_snapshots
from rankpulse.schema import Tables
from rankpulse.sources import versions
from rankpulse.sources.shared import parts_of


#: Where streams keep their state: on the executors' disks, with its changes in the checkpoint folder, so it may outgrow memory.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Logarithm of a sketch's size: 2 ** 14 entries, a relative standard error of below 1 %.
SKETCH = 14


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """The files of a folder as a stream, those there first, in batches of at most so many files if given."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def daily_panel(events: DataFrame, delay: str = "7 days", exact: bool = False) -> DataFrame:
    """Events, users and mean value by day and type. Distinct users are estimated in streams, exact in batch."""
    users = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), users.alias("n_users"), F.avg("value").alias("mean_value"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n_events", "n_users", "mean_value")


def panel_state(events: DataFrame, delay: str = "7 days", grain: str = "1 day") -> DataFrame:
    """The panel by period and type in a form that can be merged: counts, sums and a sketch of the users. In streams the state of a period goes when the watermark has passed it."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    sums = [F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"), F.count("value").alias("n_values"), F.hll_sketch_agg("user_id", SKETCH).alias("users")]
    return rows.groupBy(F.window("ts", grain).alias("w"), "event_type").agg(*sums).select(F.to_date("w.start").alias("day"), "event_type", "n_events", "total", "n_values", "users")


def merge_panels(states: DataFrame, grain: str = "day") -> DataFrame:
    """The panel of coarser periods from the states of its days, without a look at events: day, event_type, n_events, mean_value and n_users, which is estimated."""
    day = F.to_date(F.date_trunc(grain, "day")).alias("day")
    sums = states.groupBy(day, "event_type").agg(F.sum("n_events").alias("n_events"), F.sum("total").alias("_total"), F.sum("n_values").alias("_n"), F.hll_union_agg("users").alias("_users"))
    return sums.select("day", "event_type", "n_events", (F.col("_total") / F.nullif("_n", F.lit(0))).alias("mean_value"), F.hll_sketch_estimate("_users").alias("n_users"))


def user_state(events: DataFrame, delay: str = "7 days", grain: str = "1 day") -> DataFrame:
    """The panel by period, type and user: as panel_state, but from it distinct users are exact. In streams the state has a row for each user of a period until the watermark has passed that."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    sums = [F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"), F.count("value").alias("n_values")]
    return rows.groupBy(F.window("ts", grain).alias("w"), "event_type", "user_id").agg(*sums).select(F.to_date("w.start").alias("day"), "event_type", "user_id", "n_events", "total", "n_values")


def panel_of_users(states: DataFrame, grain: str = "day") -> DataFrame:
    """The panel of the same or coarser periods from user_state: day, event_type, n_events, n_users, mean_value."""
    day = F.to_date(F.date_trunc(grain, "day")).alias("day")
    sums = states.groupBy(day, "event_type").agg(F.sum("n_events").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.sum("total").alias("_total"), F.sum("n_values").alias("_n"))
    return sums.select("day", "event_type", "n_events", "n_users", (F.col("_total") / F.nullif("_n", F.lit(0))).alias("mean_value"))


def first_of(events: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """For each key the columns of its first event, also where events come in any order; in streams the state has a row for each key."""
    at = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in columns])


def last_of(events: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """For each key the columns of its last event, likewise."""
    at = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in columns])


def keep_changes(stream: DataFrame, kept: str, checkpoint: str, mode: str = "update") -> list[dict]:
    """Writes what each batch of a stream changes, or adds, under its number; a batch that is repeated after a failure writes the same files again. Gives the progress of the batches."""
    return run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{kept}/batch={i}"), checkpoint, mode)


def latest(spark: SparkSession, kept: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The rows of each key as its last change left them."""
    return newest(spark.read.schema(f"{schema}, batch int").parquet(kept), keys, F.desc("batch")).drop("batch")


def dedupe(events: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """The first event of each key: in streams of those within the delay."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return newest(events, keys, "ts")


def dedupe_kept(stream: DataFrame, keys: Sequence[str], kept: str, checkpoint: str, schema: str, delay: str = "7 days") -> list[dict]:
    """Writes of each batch the first event of each key, unless the batches before wrote the key at most `delay` earlier or later. Gives the progress of the batches.

    As dedupe, but what is written is the state: a batch is joined with the written events of its own time and `delay` around it, so no store of keys is kept beside
    them, searched key by key and cleared. Keys that are null are equal. A batch reads batches of smaller numbers and overwrites its own, so it is exactly once.
    schema: the stream's columns.
    """
    spark = stream.sparkSession
    key = F.struct(*keys).alias("_key")
    span = F.expr(f"interval {delay}")

    def each(batch: DataFrame, i: int) -> None:
        n, first, last = batch.agg(F.count(F.lit(1)), F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        parts = parts_of(spark, n)
        rows = newest(batch.select("*", key).repartition(parts, "_key"), ["_key"], "ts")
        if first is not None and _exists(spark, kept):
            near = F.col("ts").between(F.timestamp_micros(F.lit(first)) - span, F.timestamp_micros(F.lit(last)) + span)
            known = spark.read.schema(f"{schema}, batch int").parquet(kept).filter((F.col("batch") < i) & near).select(key.alias("_known"), F.col("ts").alias("_at"))
            same = (F.col("_key") == F.col("_known")) & F.col("_at").between(F.col("ts") - span, F.col("ts") + span)
            rows = rows.join(known.repartition(parts, "_known"), same, "left_anti")
        rows.drop("_key").write.mode("overwrite").parquet(f"{kept}/batch={i}")

    return run_available(stream, each, checkpoint)


def split_late(events: DataFrame, last: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows not older than `days` before the last time, and those for quarantine."""
    late = F.col("ts") < F.lit(last).cast("timestamp") - F.expr(f"interval {days} days")
    return events.filter(~late), events.filter(late)


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> Tables:
    """Saves the items that a stream has as snapshots, batch by batch, and gives the tables after the last one.

    Batch i writes version i from the last complete version before it, which it finds in the folder: the buckets that it changes, and the manifest
    that is its commit (sources/versions.py). So it is exactly once, also when a batch is repeated after a failure or another session goes on from the checkpoint.
    """
    spark = stream.sparkSession

    def last(before: int) -> tuple[int | None, Tables]:
        known = [v for v in versions.numbers(spark, folder) if v < before]
        return (known[-1], versions.read(spark, folder, known[-1])) if known else (None, empty_tables(spark))

    def each(batch: DataFrame, i: int) -> None:
        number, tables = last(i)
        work = f"{folder}/work/{uuid.uuid4().hex}"
        saved = save_snapshots(tables, batch, work=work)
        versions.write(spark, folder, i, saved, number)
        spark._jvm.org.apache.hadoop.fs.Path(work).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(work), True)

    run_available(stream, each, checkpoint)
    return last(1 << 62)[1]


def replace_days(kept: str, batch: DataFrame, *columns: str) -> None:
    """Writes the days of a batch over the kept ones, and no others: kept is a folder partitioned by day (or by these columns)."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(columns or ("day",))).parquet(kept)


def late_days(stream: DataFrame, folder: str, checkpoint: str, schema: str, days: int) -> None:
    """Keeps a stream's daily panel right when rows are late: those that are at most `days` older than the newest row of the batches before are taken in,
    and the days that they touch are computed anew from the kept rows; older ones go to quarantine.

    folder has `rows` by day and batch, `panel` by day and `quarantine` by batch. Each is overwritten partition by partition, by numbers that a repeated batch has
    again, so it is exactly once, and the files of days that a batch doesn't touch stay.
    """
    spark = stream.sparkSession
    rows_of = lambda: spark.read.schema(f"{schema}, day date, batch int").parquet(f"{folder}/rows")
    known = lambda: _exists(spark, f"{folder}/rows")

    def each(batch: DataFrame, i: int) -> None:
        # of the batches before: what a failed attempt of this one left doesn't count
        last = rows_of().filter(F.col("batch") < i).agg(F.max("ts").cast("string")).first()[0] if known() else None
        good, late = split_late(batch, last, days) if last else (batch, batch.limit(0))
        late.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={i}")
        replace_days(f"{folder}/rows", good.withColumns({"day": F.to_date("ts"), "batch": F.lit(i)}), "day", "batch")
        touched = [r[0] for r in good.select(F.to_date("ts").alias("day")).distinct().collect()]
        if touched:
            again = rows_of().filter(F.col("day").isin(touched) & (F.col("batch") <= i)).drop("day", "batch")
            replace_days(f"{folder}/panel", daily_panel(again, exact=True))

    run_available(stream, each, checkpoint)


def keep_panel(rows: DataFrame, folder: str, batch: int, **how: object) -> None:
    """Adds the state of a batch of rows (operators/panelstate.py; how: dim, top_n, metric) to a folder, by day and batch: a batch that is
    repeated overwrites what it wrote, and rows of a day may come in several batches."""
    for name, df in panelstate.panel_state(rows, **how).items():
        replace_days(f"{folder}/{name}", df.withColumn("batch", F.lit(batch)), "period", "batch")


def kept_panel(spark: SparkSession, folder: str) -> panelstate.State:
    """The state that a folder has, of all days and batches."""
    return {name: spark.read.schema(f"{ddl}, batch int").parquet(f"{folder}/{name}").drop("batch") for name, ddl in panelstate.STATE.items()}


def panel_stream(stream: DataFrame, folder: str, checkpoint: str, **how: object) -> None:
    """Keeps a panel's state as rows of a long table arrive; no batch reads the rows or the state of those before."""
    run_available(stream, lambda batch, i: keep_panel(batch, folder, i, **how), checkpoint)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def recompute_days(panel: DataFrame, rows: DataFrame, late: DataFrame) -> DataFrame:
    """The daily panel after late rows: the days that they touch are computed anew from all rows of those days, the others stay."""
    days = late.select(F.to_date("ts").alias("day")).distinct()
    again = rows.unionByName(late).withColumn("day", F.to_date("ts")).join(days, "day", "left_semi").drop("day")
    return panel.join(days, "day", "left_anti").unionByName(daily_panel(again, exact=True))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Feeds all that is there to `each`, batch by batch, and gives the batches' progress. A batch that is repeated after a failure has the same number, so `each`
    writes under that number to be exactly once. State is kept in the checkpoint folder: a later run goes on with it."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE[0])
    conf.set(*STATE_STORE)
    try:
        query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(STATE_STORE[0], before)
    return [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress]
