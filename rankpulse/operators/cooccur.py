"""Tags that stand together on an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrence(df: DataFrame, k: int = 2, top_n: int | None = 30) -> DataFrame:
    """Unordered combinations of k tags by how many (platform, period, list, item) have them; the most frequent top_n, or all.

    An item's tags are gathered once as a sorted array, and its combinations made from it in the row: no self-join of the long table.
    """
    keys = ["platform", "period", "rank_family", "rank_sub_cat", "novel_uid"]
    sets = df.filter("tag_u is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("tag_u")).alias("tags"))
    rows = sets.filter(F.size("tags") >= k).select("tags", F.posexplode("tags").alias("_p", "tag_1"))
    for i in range(2, k + 1):
        rest = F.filter("tags", lambda t, j: j > F.col("_p"))  # noqa: B023
        rows = rows.withColumn("_from", F.col("_p")).select("tags", *[f"tag_{j}" for j in range(1, i)], "_from", F.posexplode(rest).alias("_q", f"tag_{i}"))
        rows = rows.withColumn("_p", F.col("_from") + 1 + F.col("_q")).drop("_from", "_q")
    names = [f"tag_{i}" for i in range(1, k + 1)]
    out = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return out if top_n is None else out.orderBy(F.desc("n"), *names).limit(top_n)
