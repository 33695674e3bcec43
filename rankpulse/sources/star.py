"""The star schema from files, and derived from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankpulse.schema import SCHEMAS, Tables
from rankpulse.sources.shared import cut, parts_of


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder, with their schemas given, not inferred."""
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in SCHEMAS.items()}


def write_tables(tables: Tables, folder: str) -> None:
    """One version of all tables in a new folder; a version is complete or absent, as readers are given its folder afterwards."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def facts(spark: SparkSession, sf_dir: str, grain: str = "year") -> DataFrame:
    """Quantity by platform, list, period and part: parts with an even key are on alpha, the others on beta; a list is an order priority."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    # the period is made of orders, before each of their lines has it
    orders = read("orders").select("o_orderkey", F.trunc("o_orderdate", grain).alias("snapshot_date"), F.col("o_orderpriority").alias("rank_family"))
    # the number of lines says how many tasks it takes: orders, parts and lists are dealt out so that none grows with the tables
    parts = parts_of(spark, lines.count())
    joined = lines.repartition(parts, "l_orderkey").join(orders, lines.l_orderkey == orders.o_orderkey).repartition(parts, "l_partkey")
    platform = F.when(F.col("l_partkey") % 2 == 0, "alpha").otherwise("beta")
    sums = joined.groupBy("l_partkey", "rank_family", "snapshot_date").agg(F.sum("l_quantity").cast("long").alias("metric"))
    return sums.select(platform.alias("platform"), "rank_family", F.lit("").alias("rank_sub_cat"), "snapshot_date", F.col("l_partkey").alias("novel_uid"), "metric")


def star(spark: SparkSession, sf_dir: str, list_size: int | None = None, grain: str = "year") -> Tables:
    """All tables but chapters, from orders, lineitem and part; of each list the first list_size items, or all.

    The facts, by part, their ranks, the parts on lists and the three small tables are written once; all tables are read from them. Facts are ranked
    by the number of their list, so no names are shuffled and sorted with them.
    """
    made = cut(facts(spark, sf_dir, grain))
    keys = ["platform", "rank_family", "rank_sub_cat"]
    lists = made.select(*keys).distinct().withColumn("rank_list_id", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    lists = cut(lists.select("rank_list_id", *keys, F.concat(F.lit("https://example.org/"), "platform").alias("source_url")))
    of = ["rank_list_id", "snapshot_date"]
    order = Window.partitionBy(*of).orderBy(F.desc("metric"), "novel_uid")
    same = [made[k].eqNullSafe(lists[k]) for k in keys]
    listed = made.join(lists, same[0] & same[1] & same[2]).select(*of, "novel_uid", "metric")
    ranked = listed.repartition(parts_of(spark, made.count()), *of).withColumn("rank", F.row_number().over(order))
    if list_size is not None:
        ranked = ranked.filter(F.col("rank") <= list_size)
    ranked = cut(ranked)
    period = F.year("snapshot_date") * 100 + F.month("snapshot_date")
    placed = ranked.join(lists.na.drop(subset=keys).select("rank_list_id", "platform"), "rank_list_id").withColumn("snapshot_id", F.col("rank_list_id") * 1000000 + period)
    snapshots = cut(placed.groupBy("snapshot_id", "rank_list_id", "snapshot_date").agg(F.count(F.lit(1)).cast("int").alias("item_count")))
    entries = placed.select(
        "snapshot_id",
        "novel_uid",
        "rank",
        F.when(F.col("platform") == "alpha", F.col("metric")).alias("total_recommend"),
        F.when(F.col("platform") == "beta", F.col("metric")).alias("reading_count"),
        F.lit("{}").alias("extra_json"),
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    top = made if list_size is None else ranked.join(lists, "rank_list_id")
    seen = top.groupBy("novel_uid", "platform").agg(F.min("snapshot_date").alias("created_date"), F.max("snapshot_date").alias("last_seen_date"))
    parts = cut(seen.join(part, F.col("novel_uid") == F.col("p_partkey")))
    alpha = F.col("platform") == "alpha"
    novels = parts.select(
        "novel_uid",
        "platform",
        F.concat(F.lit("pk"), F.col("novel_uid").cast("string")).alias("platform_novel_id"),
        F.col("p_brand").alias("author"),
        F.lower("p_brand").alias("author_norm"),
        F.concat_ws(" ", "p_type", "p_name").alias("intro"),
        F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("intro_norm"),
        F.when(alpha, F.concat("p_type", F.lit("·"), "p_brand")).otherwise(F.col("p_type")).alias("main_category"),
        F.when(F.col("p_size") > 25, "完本").otherwise("连载").alias("status"),
        (F.col("p_size") * 10000).cast("long").alias("total_words"),
        F.concat(F.lit("https://example.org/book/"), F.col("novel_uid").cast("string")).alias("url"),
        F.lit("{}").alias("signature_json"),
        "created_date",
        "last_seen_date",
    )
    titles = parts.select(
        F.col("novel_uid").alias("title_id"),
        "novel_uid",
        F.col("p_name").alias("title"),
        F.lower("p_name").alias("title_norm"),
        F.lit(1).alias("is_primary"),
        F.col("created_date").alias("first_seen_date"),
        "last_seen_date",
    )
    names = F.when(alpha, F.array("p_brand")).otherwise(F.array_distinct(F.concat(F.filter(F.split("p_name", " "), lambda x: x != ""), F.array("p_brand"))))
    tagged = parts.select("novel_uid", F.explode(names).alias("tag_name"))
    tags = tagged.select("tag_name").distinct().withColumn("tag_norm", F.lower("tag_name"))
    tags = cut(tags.select(F.row_number().over(Window.orderBy("tag_name")).cast("long").alias("tag_id"), "tag_name", "tag_norm"))
    tag_map = tagged.join(tags, "tag_name").select("novel_uid", "tag_id").distinct()
    return {"novels": novels, "novel_titles": titles, "tags": tags, "novel_tag_map": tag_map, "rank_lists": lists, "rank_snapshots": snapshots, "rank_entries": entries}
