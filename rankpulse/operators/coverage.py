"""What the data covers, and where it contradicts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.functions.text import days_span
from rankpulse.operators.panel import LIST
from rankpulse.schema import Tables


def platform_coverage(df: DataFrame) -> DataFrame:
    """Dates, distinct snapshot days and items of each platform."""
    out = df.groupBy("platform").agg(
        F.min("snapshot_date").alias("min_date"), F.max("snapshot_date").alias("max_date"), F.count_distinct("snapshot_date").alias("unique_snapshots"), F.count_distinct("novel_uid").alias("unique_novels")
    )
    return out.withColumn("days_span", days_span(F.col("min_date"), F.col("max_date")))


def list_coverage(df: DataFrame) -> DataFrame:
    """Mean items a day, days, dates and distinct items of each list."""
    daily = df.groupBy(*LIST, "snapshot_date").agg(F.count_distinct("novel_uid").alias("_n"))
    days = daily.groupBy(*LIST).agg(F.avg("_n").alias("avg_daily_books"), F.count(F.lit(1)).alias("days_seen"), F.min("snapshot_date").alias("min_date"), F.max("snapshot_date").alias("max_date"))
    books = df.groupBy(*LIST).agg(F.count_distinct("novel_uid").alias("total_books"))
    return days.join(books, LIST).withColumn("days_span", days_span(F.col("min_date"), F.col("max_date")))


def table_counts(tables: Tables) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def item_counts(tables: Tables) -> DataFrame:
    """Declared and actual entries of each snapshot; the entries are counted once, before the join."""
    actual = tables["rank_entries"].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = tables["rank_snapshots"].join(actual, "snapshot_id", "left").join(tables["rank_lists"].select("rank_list_id", *LIST), "rank_list_id")
    return rows.select("snapshot_id", *LIST, "snapshot_date", F.col("item_count").cast("long").alias("declared"), F.coalesce("_n", F.lit(0)).alias("actual"))


def item_count_mismatch(tables: Tables, limit: int | None = 100) -> DataFrame:
    """Snapshots that declare another number of entries than they have, newest first."""
    out = item_counts(tables).filter("declared <> actual")
    return out if limit is None else out.orderBy(F.desc("snapshot_date"), F.desc("snapshot_id")).limit(limit)


def chapter_stats(chapters: DataFrame, novels: DataFrame) -> DataFrame:
    """Chapters and the highest number of each item, 0 without any."""
    counts = chapters.groupBy("novel_uid").agg(F.count(F.lit(1)).alias("n_chapters"), F.max("chapter_num").alias("_max"))
    return novels.select("novel_uid").join(counts, "novel_uid", "left").select("novel_uid", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("_max", F.lit(0)).alias("max_chapter"))


def run_summary(tables: Tables) -> DataFrame:
    """Lists and entries of each platform and day."""
    rows = tables["rank_entries"].join(tables["rank_snapshots"], "snapshot_id").join(tables["rank_lists"], "rank_list_id")
    return rows.groupBy("platform", "snapshot_date").agg(F.count_distinct("rank_list_id").alias("n_lists"), F.count(F.lit(1)).alias("n_entries"), F.count_distinct("novel_uid").alias("n_novels"))


def concentration_by_period(panel: DataFrame) -> DataFrame:
    """Mean concentration of each platform and period, over the panel's rows."""
    return panel.groupBy("platform", "period").agg(F.avg("concentration_index").alias("concentration"))
