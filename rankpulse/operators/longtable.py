"""The long table: a row for each period, list, item and tag; and the window of periods that it covers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.schema import Tables
from rankpulse.sources.shared import dealt, parts_of

#: Days that a named look-back spans.
LOOKBACKS = {"week": 7, "month": 30, "quarter": 90, "year": 365}


def long_table(tables: Tables, start: str | date | None = None, end: str | date | None = None, platform: str | None = None, family: str | None = None, sub_cat: str | None = None, per_item: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entries with their snapshot, list, item and tags. Filters sit on the small tables, before the joins. per_item adds columns to items with a tag
    each (main_category and tag_name among theirs), so what depends on these alone is computed before the entries are joined."""
    snapshots = tables["rank_snapshots"].select("snapshot_id", "rank_list_id", "snapshot_date")
    if start is not None:
        snapshots = snapshots.filter(F.col("snapshot_date") >= F.lit(start).cast("date"))
    if end is not None:
        snapshots = snapshots.filter(F.col("snapshot_date") <= F.lit(end).cast("date"))
    lists = tables["rank_lists"].select("rank_list_id", "platform", "rank_family", "rank_sub_cat")
    for column, value in (("platform", platform), ("rank_family", family), ("rank_sub_cat", sub_cat)):
        if value is not None and value != "both":
            lists = lists.filter(F.col(column) == value)
    entries = tables["rank_entries"].select("snapshot_id", "novel_uid", "rank", "total_recommend", "reading_count")
    novels = tables["novels"].select("novel_uid", "main_category", "status", "total_words", "created_date", "last_seen_date")
    tags = tables["novel_tag_map"].join(tables["tags"].select("tag_id", "tag_name"), "tag_id", "left").select("novel_uid", "tag_name")
    items = novels.join(tags, "novel_uid", "left")
    columns = items.columns
    items = items if per_item is None else per_item(items)
    placed = entries.join(snapshots.join(lists, "rank_list_id"), "snapshot_id")
    rows = dealt(placed, "novel_uid").join(items, "novel_uid")
    return rows.select(
        "snapshot_date", "platform", "rank_family", "rank_sub_cat", "rank_list_id", "snapshot_id", "novel_uid", "rank", "total_recommend", "reading_count",
        "main_category", "status", "total_words", "created_date", "last_seen_date", "tag_name", *[c for c in items.columns if c not in columns],
    )


def counted_table(tables: Tables, topic: Column, dim: str = "cat_u") -> DataFrame:
    """The long table by entries, without a row for each tag, for a topic that the item's category alone says: a row for each period (the date), list, item and topic.

    n_rows is how many rows of the long table it stands for, is_first whether the topic is the first of the item's, if it has several. Tags are counted by item
    before the entries are joined, and names of lists come last, so only numbers are dealt out.
    """
    entries = tables["rank_entries"].select("snapshot_id", "novel_uid", "rank", "total_recommend", "reading_count")
    # items, tags and entries in the same partitions, else Spark deals the entries out in those of the items
    parts = parts_of(entries.sparkSession, entries.count())
    tags = tables["novel_tag_map"].select("novel_uid").repartition(parts, "novel_uid").groupBy("novel_uid").agg(F.count(F.lit(1)).alias("_tags"))
    novels = tables["novels"].select("novel_uid", topic.alias(dim)).repartition(parts, "novel_uid").join(tags, "novel_uid", "left")
    items = novels.groupBy("novel_uid", dim).agg(F.sum(F.coalesce("_tags", F.lit(1))).alias("n_rows"))
    items = items.withColumn("is_first", F.row_number().over(Window.partitionBy("novel_uid").orderBy(dim)) == 1)
    lists = tables["rank_lists"].select("rank_list_id", "platform", "rank_family", "rank_sub_cat")
    snapshots = tables["rank_snapshots"].select("snapshot_id", "rank_list_id", F.to_date("snapshot_date").alias("period")).join(lists, "rank_list_id")
    rows = entries.repartition(parts, "novel_uid").join(items, "novel_uid").join(snapshots, "snapshot_id")
    return rows.select("platform", "rank_family", "rank_sub_cat", "period", "novel_uid", "rank", "total_recommend", "reading_count", dim, "n_rows", "is_first")


def date_range(snapshots: DataFrame) -> DataFrame:
    """One row: first and last snapshot date."""
    return snapshots.agg(F.min("snapshot_date").alias("min_date"), F.max("snapshot_date").alias("max_date"))


def resolve_window(snapshots: DataFrame, lookback: str, today: str | None = None) -> DataFrame:
    """One row: start and end of a look-back that ends today (in New York unless given), not before the first snapshot."""
    end = F.to_date(F.lit(today)) if today else F.to_date(F.from_utc_timestamp(F.current_timestamp(), "America/New_York"))
    first = F.col("min_date")
    start = first if lookback == "all" else F.greatest(first, F.date_sub(end, LOOKBACKS[lookback]))
    return date_range(snapshots).select(F.lit(lookback).alias("lookback"), start.alias("start_date"), end.alias("end_date"))
