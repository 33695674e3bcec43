"""New entries, and where a newcomer has the best opening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.functions.text import days_span, ratio
from rankpulse.schema import PLATFORMS, Platform

#: Which of several rows of an item counts, where its columns differ.
ORDER = ["snapshot_date", "rank_family", "rank_sub_cat", "rank", "tag_name"]


def keep_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key in ORDER."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def is_new(start: str, end: str, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """On some platforms items of certain families are new, on others those first seen in the window."""
    out = F.lit(False)
    for p in platforms:
        if p.new_families is None:
            rule = F.coalesce(F.col("created_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
        else:
            rule = F.col("rank_family").isin(*p.new_families)
        out = F.when(F.col("platform") == p.name, rule).otherwise(out)
    return out


def new_entry_ratio(df: DataFrame, by: Sequence[str], start: str, end: str, platforms: Sequence[Platform] = PLATFORMS) -> DataFrame:
    """Items and new items of each group, each item counted once, by its first row; groups with a missing key go."""
    keys = ["platform", *by]
    once = keep_first(df.na.drop(subset=list(by)), [*keys, "novel_uid"]).withColumn("_new", is_new(start, end, platforms))
    out = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_books"), F.sum(F.col("_new").cast("long")).alias("new_books"))
    return out.withColumn("new_entry_ratio", ratio(F.col("new_books"), F.col("total_books")))


def new_entry_table(ratios: DataFrame, by: Sequence[str], n: int = 30) -> DataFrame:
    """The groups of the highest ratios, highest first; of equal ones by name. The table of the report shows n."""
    return ratios.orderBy(F.desc_nulls_last("new_entry_ratio"), "platform", *by).limit(n)


def new_book_heat(df: DataFrame, start: str, end: str, platforms: Sequence[Platform] = PLATFORMS) -> DataFrame:
    """Mean heat of the rows of new items, by platform and topic."""
    new = is_new(start, end, platforms)
    return df.filter("tag_u is not null").groupBy("platform", "tag_u").agg(F.avg(F.when(new, F.col("heat_raw"))).alias("new_heat"), F.count(F.when(new, 1)).alias("new_rows"))


def zscore(x: Column, part: Sequence[str]) -> Column:
    """Distance from the mean in population standard deviations; the epsilon keeps constant groups at 0."""
    w = Window.partitionBy(*part)
    return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-12)


def opening_opportunities(df: DataFrame, start: str, end: str, platforms: Sequence[Platform] = PLATFORMS, top_n: int = 80, min_total: int = 5, per_platform: bool = False, digits: int | None = None) -> DataFrame:
    """Topics of a category by growth of share and heat and by new entries; the best top_n, over all platforms or of each.

    digits rounds the score before it orders, for results that must agree between engines.
    """
    rows = df.filter(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).na.drop(subset=["cat_u", "tag_u"])
    keys = ["platform", "cat_u", "tag_u"]
    totals = rows.groupBy("platform", "period").agg(F.count_distinct("novel_uid").alias("_all"))
    daily = keep_first(rows, [*keys, "period", "novel_uid"]).groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("_books"), F.avg("heat_raw").alias("_heat"))
    daily = daily.join(totals, ["platform", "period"]).withColumn("_share", ratio(F.col("_books"), F.col("_all")))
    spans = daily.groupBy(*keys).agg(
        F.min("period").alias("first_date"),
        F.max("period").alias("last_date"),
        F.min_by("_share", "period").alias("start_share"),
        F.max_by("_share", "period").alias("end_share"),
        F.min_by("_heat", "period").alias("start_heat"),
        F.max_by("_heat", "period").alias("end_heat"),
    )
    spans = spans.withColumns({"days_span": days_span(F.col("first_date"), F.col("last_date")), "share_delta": F.col("end_share") - F.col("start_share"), "heat_delta": F.col("end_heat") - F.col("start_heat")})
    new = new_entry_ratio(rows, ["cat_u", "tag_u"], start, end, platforms)
    out = spans.join(new, keys, "left").filter(F.coalesce("total_books", F.lit(0)) >= min_total)
    z = {f"z_{k}": F.coalesce(zscore(F.col(c), ["platform"]), F.lit(0.0)) for k, c in (("share", "share_delta"), ("heat", "heat_delta"), ("new", "new_entry_ratio"))}
    score = F.col("z_share") + F.col("z_heat") + 0.8 * F.col("z_new")
    out = out.withColumns(z).withColumn("opportunity_score", score if digits is None else F.round(score, digits))
    best = [F.desc("opportunity_score"), "cat_u", "tag_u"]
    if per_platform:
        order = Window.partitionBy("platform").orderBy(*best)
        return out.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_n).drop("_n")
    return out.orderBy("platform", *best).limit(top_n)
