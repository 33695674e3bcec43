"""Reads for people: pages of tables, lists, snapshots, entries and an item's dossier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.schema import Tables


def list_identity(lists: DataFrame, lookup: DataFrame, keys: Sequence[str], default: str) -> DataFrame:
    """Lists with the family and sub-category that a lookup table, a configuration of a few rows, names for their key; others have the default family and their own sub-category."""
    names = lookup.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("family").alias("_family"), F.col("sub_cat").alias("_sub"))
    # the lookup is configuration, as long as the list of lists that are read
    both = lists.join(F.broadcast(names), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return both.select(*lists.columns, F.coalesce("_family", F.lit(default)).alias("family"), F.coalesce("_sub", "rank_sub_cat").alias("sub_cat"))


def page(df: DataFrame, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a table in the order of its key; limit from 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500, offset not negative")
    return df.orderBy(key).offset(offset).limit(limit)


def lists(tables: Tables, platform: str | None = None) -> DataFrame:
    df = tables["rank_lists"]
    return (df if platform is None else df.filter(F.col("platform") == platform)).orderBy(F.desc("rank_list_id"))


def snapshots(tables: Tables, rank_list_id: int) -> DataFrame:
    return tables["rank_snapshots"].filter(F.col("rank_list_id") == rank_list_id).orderBy(F.desc("snapshot_date"), F.desc("snapshot_id"))


def entries(tables: Tables, snapshot_id: int, limit: int = 200) -> DataFrame:
    return tables["rank_entries"].filter(F.col("snapshot_id") == snapshot_id).orderBy("rank").limit(limit)


def primary_title(tables: Tables) -> DataFrame:
    """The primary title of every item."""
    titles = tables["novel_titles"].filter("is_primary = 1").select("novel_uid", "title", "title_norm")
    return tables["novels"].select("novel_uid", "platform", "platform_novel_id").join(titles, "novel_uid")


def snapshot_listing(tables: Tables) -> DataFrame:
    """Entries with their list, date, item and title."""
    rows = tables["rank_entries"].join(tables["rank_snapshots"], "snapshot_id").join(tables["rank_lists"], "rank_list_id")
    rows = rows.join(primary_title(tables).select("novel_uid", "title"), "novel_uid").join(tables["novels"].select("novel_uid", "author", "main_category"), "novel_uid")
    return rows.select("snapshot_id", "platform", "rank_family", "rank_sub_cat", "snapshot_date", "rank", "novel_uid", "title", "author", "main_category", "total_recommend", "reading_count")


def full_inspection(tables: Tables) -> DataFrame:
    """The listing with each item's tags as one text."""
    tags = tables["novel_tag_map"].join(tables["tags"], "tag_id").groupBy("novel_uid").agg(F.array_join(F.array_sort(F.collect_set("tag_name")), ",").alias("tags"))
    return snapshot_listing(tables).join(tags, "novel_uid", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def dossier(tables: Tables, novel_uid: int | None = None) -> DataFrame:
    """One row an item with its titles, tags and ranks as arrays; all items, or one."""
    one = lambda df: df if novel_uid is None else df.filter(F.col("novel_uid") == novel_uid)
    titles = one(tables["novel_titles"]).groupBy("novel_uid").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    tags = one(tables["novel_tag_map"]).join(tables["tags"], "tag_id").groupBy("novel_uid").agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    ranks = one(tables["rank_entries"]).join(tables["rank_snapshots"], "snapshot_id").groupBy("novel_uid")
    ranks = ranks.agg(F.count(F.lit(1)).alias("n_ranks"), F.min("rank").alias("best_rank"), F.max_by("rank", F.struct("snapshot_date", "snapshot_id")).alias("last_rank"))
    out = one(tables["novels"]).select("novel_uid", "platform", "author", "main_category")
    for child in (titles, tags, ranks):
        out = out.join(child, "novel_uid", "left")
    return out
