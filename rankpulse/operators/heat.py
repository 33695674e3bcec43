"""Heat: a platform's audience figure, as it is, as percentile, as robust z-score and as a mixture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpulse.schema import PLATFORMS, Platform
from rankpulse.sources.shared import cut

MAD_SCALE = 1.4826
#: Ranges of figures by which a figure grows e-fold.
RANGES = 1024


def heat_raw(platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """The metric of the row's platform; platforms that aren't listed have the first one's."""
    value = F.col(platforms[0].metric)
    for p in platforms[1:]:
        value = F.when(F.col("platform") == p.name, F.col(p.metric)).otherwise(value)
    return value.cast("double")


def running_counts(values: DataFrame, value: str, keys: Sequence[str] = ("platform",)) -> DataFrame:
    """Adds below and total to a histogram (keys, value, n): how many rows of the same keys have a smaller value, or any.

    Values are dealt into ranges of equal ratio and summed range by range, so that no task sorts a whole platform: a range at a figure
    v has v / RANGES whole figures at most. Where ranges begin changes no sum.
    """
    v = F.col(value)
    dealt = values.withColumn("_bucket", F.floor(F.signum(v) * F.log1p(F.abs(v)) * RANGES))
    start = Window.unboundedPreceding
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(start, -1))
    sums = sums.select(*keys, "_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(start, -1))
    return dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "_bucket"]).select(*keys, value, "n", (F.col("_before") + F.col("_inside")).alias("below"), "total")


def median_of(running: DataFrame, value: str, name: str, keys: Sequence[str] = ("platform",)) -> DataFrame:
    """The median of each of the keys, from running counts: the mean of the middle value or two."""
    at = lambda k: F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("n") > k), F.col(value)))
    middle = (F.col("total") - 1) / 2
    return running.groupBy(*keys).agg((0.5 * at(F.floor(middle)) + 0.5 * at(F.ceil(middle))).alias(name))


def add_raw(df: DataFrame, platforms: Sequence[Platform] = PLATFORMS) -> DataFrame:
    """Adds heat_raw alone, for what needs no percentiles or scores. Rows without a platform go."""
    return df.filter("platform is not null").withColumn("heat_raw", heat_raw(platforms))


def add_heat(df: DataFrame, platforms: Sequence[Platform] = PLATFORMS, alpha: float = 0.7, tanh_c: float = 3.0) -> DataFrame:
    """Adds heat_raw, heat_pct, heat_rz, heat_rz01, heat_mix. Rows without a platform go.

    heat_pct is the average rank of ties by the number of values of the platform. It, the median and the median deviation come from a
    histogram of values with running counts. The histogram and what comes of it are written, so that Spark knows how small they are and doesn't
    deal the rows out by figure, which would put those of a frequent one into one task.
    """
    df = add_raw(df, platforms)
    values = cut(df.filter("heat_raw is not null").groupBy("platform", "heat_raw").agg(F.count(F.lit(1)).alias("n")))
    running = cut(running_counts(values, "heat_raw"))
    median = median_of(running, "heat_raw", "_median")
    apart = values.join(median, "platform").groupBy("platform", F.abs(F.col("heat_raw") - F.col("_median")).alias("_apart")).agg(F.sum("n").alias("n"))
    centre = cut(median.join(median_of(running_counts(apart, "_apart"), "_apart", "_mad"), "platform"))
    ranked = running.select("platform", "heat_raw", ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias("heat_pct"))
    df = df.join(centre, "platform", "left").join(ranked, ["platform", "heat_raw"], "left")
    usable = F.coalesce(F.col("_mad"), F.lit(0.0)) > 0
    df = df.withColumn("heat_rz", F.when(usable, (F.col("heat_raw") - F.col("_median")) / (MAD_SCALE * F.col("_mad"))).otherwise(F.lit(0.0)))
    df = df.withColumn("heat_rz01", (F.tanh(F.col("heat_rz") / tanh_c) + 1) / 2)
    return df.withColumn("heat_mix", alpha * F.col("heat_pct") + (1 - alpha) * F.col("heat_rz01")).drop("_median", "_mad")
