"""Report sections and chart data from panels and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpulse.operators.panel import LIST


def tag_summary(roll: DataFrame, platform: str, k: int = 10, order_by: str = "mean_share", digits: int | None = None) -> DataFrame:
    """A platform's topics by the mean over lists of their means; the first k."""
    keep = lambda c: c if digits is None else F.round(c, digits)
    out = roll.filter(F.col("platform") == platform).groupBy("tag_u").agg(keep(F.avg("mean_share")).alias("mean_share"), keep(F.avg("avg_heat")).alias("avg_heat"), keep(F.avg("mean_rank")).alias("mean_rank"))
    return out.orderBy(F.desc(order_by), "tag_u").limit(k)


def list_structure(panel: DataFrame, coverage: DataFrame, platform: str, sub_cat_when: Column | None = None, with_books: bool = False) -> DataFrame:
    """A platform's lists: mean heat, threshold and concentration over periods, and their coverage. sub_cat_when says for which
    families the sub-category is kept; with_books adds the items a day."""
    sub = F.col("rank_sub_cat") if sub_cat_when is None else F.when(sub_cat_when, F.col("rank_sub_cat")).otherwise(F.lit(""))
    rows = panel.filter(F.col("platform") == platform).withColumn("_sub", sub)
    aggs = [F.avg("avg_heat_raw").alias("h"), F.avg("entry_threshold").alias("t"), F.avg("concentration_index").alias("c")] + [F.max("books_in_group").alias("b")] * with_books
    daily = rows.groupBy("rank_family", "_sub", "period").agg(*aggs)
    out = daily.groupBy("rank_family", "_sub").agg(F.avg("h").alias("avg_heat"), F.avg("t").alias("avg_threshold"), F.avg("c").alias("avg_concentration"), *[F.avg("b").alias("books_per_day")] * with_books)
    cover = coverage.filter(F.col("platform") == platform).withColumn("_sub", sub).groupBy(F.col("rank_family").alias("_family"), F.col("_sub").alias("_cover_sub"))
    cover = cover.agg(F.max("total_books").alias("total_books"), F.avg("avg_daily_books").alias("avg_daily_books"))
    out = out.join(cover, F.col("rank_family").eqNullSafe(F.col("_family")) & F.col("_sub").eqNullSafe(F.col("_cover_sub")), "left").drop("_family", "_cover_sub")
    return out.withColumnRenamed("_sub", "rank_sub_cat").orderBy("rank_family", F.desc("avg_daily_books"), F.desc("avg_heat"))


def platform_diff(roll_cat: DataFrame, a: str, b: str, both_only: bool = False) -> DataFrame:
    """Categories of two platforms side by side: where they are, and the differences a - b; with both_only those of both."""

    def side(name: str) -> DataFrame:
        rows = roll_cat.filter(F.col("platform") == name)
        return rows.groupBy("cat_u").agg(F.avg("mean_share").alias(f"share_{name}"), F.avg("avg_heat").alias(f"heat_{name}"), F.avg("mean_rank").alias(f"rank_{name}"), F.lit(True).alias(f"in_{name}"))

    both = side(a).join(side(b), "cat_u", "full_outer")
    ins = [F.coalesce(F.col(f"in_{x}"), F.lit(False)) for x in (a, b)]
    presence = F.when(ins[0] & ins[1], "both").when(ins[0], f"{a}_only").otherwise(f"{b}_only")
    share = F.coalesce(f"share_{a}", F.lit(0.0)) - F.coalesce(f"share_{b}", F.lit(0.0))
    out = both.withColumns({"presence": presence, "share_diff": share, "heat_diff": F.col(f"heat_{a}") - F.col(f"heat_{b}"), "rank_diff": F.col(f"rank_{a}") - F.col(f"rank_{b}")})
    out = out.filter("presence = 'both'") if both_only else out
    return out.drop(f"in_{a}", f"in_{b}").orderBy(F.desc("share_diff"), "cat_u")


def bar_topk(df: DataFrame, label: str, value: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """Labels with the highest mean value."""
    mean = F.avg(value) if digits is None else F.round(F.avg(value), digits)
    return df.na.drop(subset=[label, value]).groupBy(F.col(label).alias("label")).agg(mean.alias("value")).orderBy(F.desc("value"), "label").limit(k)


def line_topk(df: DataFrame, x: str, y: str, label: str, k: int = 5, only: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Mean of y by x for the k labels with the highest mean of those means, or for given labels."""
    points = df.na.drop(subset=[x, y, label]).groupBy(F.col(x).alias("x"), F.col(label).alias("label")).agg(F.avg(y).alias("y"))
    if only is not None:
        return points.filter(F.col("label").isin(*only)).orderBy("x", "label")
    mean = F.avg("y") if digits is None else F.round(F.avg("y"), digits)
    best = points.groupBy("label").agg(mean.alias("_m")).orderBy(F.desc("_m"), "label").limit(k).select("label")
    return points.join(best, "label", "left_semi").orderBy("x", "label")


def display(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Columns as texts for a report: numbers rounded, missing as a hyphen, an empty sub-category too."""
    kinds = dict(df.dtypes)
    shown = lambda c: F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")
    return df.select(*[F.when(F.col(c).isNull(), "-").otherwise(F.when(shown(c) == "", "-").otherwise(shown(c)) if c == "rank_sub_cat" else shown(c)).alias(c) for c in columns])


def write_sections(sections: dict[str, DataFrame], folder: str, start: str, end: str) -> None:
    """Each section as a table of its own under the report's id."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{folder}/report_id={start}_{end}/{name}")


def read_sections(spark: SparkSession, names: Sequence[str], folder: str, start: str, end: str) -> dict[str, DataFrame]:
    """The sections of a written report."""
    return {name: spark.read.parquet(f"{folder}/report_id={start}_{end}/{name}") for name in names}
