"""Panels: one row for each list, period and topic, and their roll-ups over the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.functions.text import days_span, ratio
from rankpulse.sources.shared import dealt

LIST = ["platform", "rank_family", "rank_sub_cat"]
GROUP = [*LIST, "period"]


def period_panel(df: DataFrame, dim: str = "tag_u", top_n: int = 10, metric: str = "heat_raw") -> DataFrame:
    """Topic panel. With dim "tag_u" rows without a topic go, and efficiency and head figures are added; "cat_u" keeps empty categories.

    The long table has a row for each tag, so averages are weighted by tags, as in the data model. Rows are dealt out by item and sorted there: the first of an item's
    rows of a list and period, or of a topic in it, counts it, so no task keeps a whole list.
    The median comes from a histogram of figures; shares and concentration come from windows over the panel's few rows.
    """
    tag = dim == "tag_u"
    rows = df.filter(F.col(dim).isNotNull()) if tag else df
    rows = rows.select(*GROUP, dim, "novel_uid", "rank", F.col(metric).cast("double").alias("_figure"))
    place = F.row_number().over(Window.partitionBy("novel_uid", *GROUP).orderBy(dim, F.asc_nulls_last("rank")))
    again = F.row_number().over(Window.partitionBy("novel_uid", *GROUP, dim).orderBy(F.asc_nulls_last("rank")))
    placed = dealt(rows, "novel_uid").withColumns({"_place": place, "_again": again})
    # an item's first row of a topic has its best rank there
    once = lambda first: F.count(F.when(first, F.col("novel_uid")))
    panel = placed.groupBy(*GROUP, dim).agg(
        once(F.col("_again") == 1).alias("book_count"),
        F.avg("rank").alias("avg_rank"),
        F.avg("_figure").alias("avg_heat_raw"),
        F.min("_figure").alias("entry_threshold"),
        *([once((F.col("_again") == 1) & (F.col("rank") <= top_n)).alias("top_app_count")] if tag else []),
        once(F.col("_place") == 1).alias("_firsts"),
    )
    columns = [*GROUP, dim, "book_count", "avg_rank", "avg_heat_raw"]
    if tag:
        # as one column: parts of a struct may be null and are equal then
        group = F.struct(*GROUP, dim).alias("_group")
        counts = rows.filter("_figure is not null").groupBy(group, "_figure").agg(F.count(F.lit(1)).alias("_n"))
        medians = counts.groupBy("_group").agg(F.percentile("_figure", 0.5, F.col("_n")).alias("median_heat_raw"))
        panel = panel.withColumn("_group", group).join(medians, "_group", "left").drop("_group")
    panel = panel.withColumn("books_in_group", F.sum("_firsts").over(Window.partitionBy(*GROUP)))
    return with_shares(panel.select(*columns, *(["median_heat_raw"] if tag else []), "entry_threshold", *(["top_app_count"] if tag else []), "books_in_group"), dim)


def counted_panel(df: DataFrame, dim: str = "cat_u", metric: str = "heat_raw") -> DataFrame:
    """The panel that period_panel makes of the long table, from rows that stand for several of it each (longtable.counted_table): an item has one row in a list, period and
    topic, so items are counted as rows, and none are sorted or dealt out."""
    n, figure = F.col("n_rows"), F.col(metric).cast("double")
    mean = lambda v: F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))
    panel = df.groupBy(*GROUP, dim).agg(
        F.count("novel_uid").alias("book_count"),
        mean(F.col("rank")).alias("avg_rank"),
        mean(figure).alias("avg_heat_raw"),
        F.min(figure).alias("entry_threshold"),
        F.count(F.when(F.col("is_first"), F.col("novel_uid"))).alias("_firsts"),
    )
    panel = panel.withColumn("books_in_group", F.sum("_firsts").over(Window.partitionBy(*GROUP))).drop("_firsts")
    return with_shares(panel, dim)


def with_shares(panel: DataFrame, dim: str) -> DataFrame:
    """Adds to a panel's counts, those of the items of each list and period (books_in_group) among them, shares and concentration; by tags also efficiency and head ratio."""
    tag = dim == "tag_u"
    share = "tag_share" if tag else "cat_share"
    panel = panel.withColumn(share, ratio(F.col("book_count"), F.col("books_in_group")))
    panel = panel.withColumn("concentration_index", F.sum(F.col(share) * F.col(share)).over(Window.partitionBy(*GROUP)))
    if tag:
        panel = panel.withColumns({"efficiency": ratio(F.col("avg_heat_raw"), F.col("avg_rank")), "head_ratio": ratio(F.col("top_app_count"), F.col("book_count"))})
    return panel


def ordinal_slope(y: Column, i: Column, n: Column, mean: Column) -> Column:
    """Least-squares slope over ordinal positions 0..n-1 as an aggregate: missing values count in the positions but not in the sum."""
    n = n.cast("double")
    return F.when(F.max(n) >= 2, F.sum((i - (n - 1) / 2) * (y - mean)) / F.max((n * n * n - n) / 12))


def window_rollup(panel: DataFrame, dim: str = "tag_u", share_min: float = 0.08, stage: bool = True) -> DataFrame:
    """One row a series (list and topic): means, spreads, dates, slopes by day, stage and chance."""
    keys = [*LIST, dim]
    tag = dim == "tag_u"
    share = "tag_share" if tag else "cat_share"
    series = Window.partitionBy(*keys)
    rows = panel.withColumns({"_i": F.row_number().over(series.orderBy("period")) - 1, "_n": F.count(F.lit(1)).over(series)})
    measured = {"rank": "avg_rank", "heat": "avg_heat_raw", "share": share}
    rows = rows.withColumns({f"_m_{k}": F.avg(c).over(series) for k, c in measured.items()})
    aggs = [
        F.count_distinct("period").alias("days_seen"),
        F.min("period").alias("first_date"),
        F.max("period").alias("last_date"),
        F.avg("avg_rank").alias("mean_rank"),
        F.avg(share).alias("mean_share"),
        F.avg("avg_heat_raw").alias("avg_heat"),
        F.avg("entry_threshold").alias("mean_entry_threshold"),
    ]
    if tag:
        aggs += [
            F.stddev_samp("avg_rank").alias("rank_std"),
            F.median("median_heat_raw").alias("median_heat"),
            F.stddev_samp("avg_heat_raw").alias("heat_volatility"),
            F.avg("efficiency").alias("mean_efficiency"),
            F.avg("head_ratio").alias("mean_head_ratio"),
        ]
    else:
        aggs.append(F.avg("concentration_index").alias("mean_concentration"))
    aggs += [ordinal_slope(F.col(c), F.col("_i"), F.col("_n"), F.col(f"_m_{k}")).alias(f"{k}_slope") for k, c in measured.items()]
    out = rows.groupBy(*keys).agg(*aggs).withColumn("days_span", days_span(F.col("first_date"), F.col("last_date")))
    if not (stage and tag):
        return out
    label = (
        F.when(F.col("days_seen") < 2, "unknown")
        .when((F.col("mean_share") >= share_min) & (F.col("avg_heat") >= F.col("median_heat")), "safe")
        .when((F.col("share_slope") > 0) & (F.col("heat_slope") > 0), "chance")
        .otherwise("stable")
    )
    return out.withColumns({"stage": label, "chance": F.col("heat_slope") + F.col("share_slope") - F.col("rank_slope")})
