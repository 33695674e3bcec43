"""Topics that both platforms share: period, tag_u and cat_u."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpulse.functions import text as T
from rankpulse.schema import PLATFORMS, Platform

# Merged category, and what a category must contain for it, in order.
CATEGORY_RULES = (("都市", "都市"), ("科幻", "科幻"), ("奇幻", "奇幻"), ("悬疑", "悬疑"), ("玄幻", "玄幻"))


def sub_category(category: Column) -> Column:
    """The last part of `main·sub` that isn't blank; the whole if there is no separator; blank is missing."""
    parts = F.filter(F.transform(F.split(category, "·"), T.strip), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


def unified_category(category: Column, rules: Sequence[tuple[str, str]] = CATEGORY_RULES) -> Column:
    """The first rule whose text the category contains, else the trimmed category; missing is empty."""
    value = T.strip(F.coalesce(category, F.lit("")))
    out = value
    for name, part in reversed(rules):
        out = F.when(F.contains(value, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def unified_tag(platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """Sub-category or tag name, by platform; blank is missing."""
    tag = T.strip(F.col("tag_name"))
    value = F.when(tag != "", tag)
    for p in platforms:
        if p.by_sub_category:
            value = F.when(F.col("platform") == p.name, sub_category(F.col("main_category"))).otherwise(value)
    return value


def add_topics(items: DataFrame, rules: Sequence[tuple[str, str]] = CATEGORY_RULES) -> DataFrame:
    """What unify_rows needs of items with a tag each (main_category, tag_name): _sub, _tag and cat_u."""
    tag = T.strip(F.col("tag_name"))
    return items.withColumns({"_sub": sub_category(F.col("main_category")), "_tag": F.when(tag != "", tag), "cat_u": unified_category(F.col("main_category"), rules)})


def unify_rows(df: DataFrame, platforms: Sequence[Platform] = PLATFORMS, grain: str = "day") -> DataFrame:
    """Rows with the columns of add_topics as add_unified makes them of those without."""
    topic = F.col("_tag")
    for p in platforms:
        if p.by_sub_category:
            topic = F.when(F.col("platform") == p.name, F.col("_sub")).otherwise(topic)
    return df.withColumns({"period": period_of(grain), "tag_u": topic}).drop("_sub", "_tag")


def period_of(grain: str) -> Column:
    """The date, or the start of its week, month or year."""
    day = F.to_date("snapshot_date")
    return day if grain == "day" else F.to_date(F.date_trunc(grain, day))


def add_unified(df: DataFrame, platforms: Sequence[Platform] = PLATFORMS, rules: Sequence[tuple[str, str]] = CATEGORY_RULES, grain: str = "day") -> DataFrame:
    """Adds period (the date, or the start of its week, month or year), tag_u and cat_u."""
    return df.withColumns({"period": period_of(grain), "tag_u": unified_tag(platforms), "cat_u": unified_category(F.col("main_category"), rules)})


def split_category(category: Column, mains: Sequence[str], sub_to_main: dict[str, str]) -> Column:
    """Struct of main and sub from `main·sub`, from a main name at the start, or from a known sub-category, in the listed order."""
    value = T.strip(F.coalesce(category, F.lit("")))
    parts = F.filter(F.transform(F.split(value, "·"), T.strip), lambda x: x != "")
    main, sub = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, m in reversed(list(sub_to_main.items())):
        hit = F.contains(value, F.lit(s))
        main, sub = F.when(hit, F.lit(m)).otherwise(main), F.when(hit, F.lit(s)).otherwise(sub)
    for m in reversed(mains):
        hit = F.startswith(value, F.lit(m))
        rest = T.strip(F.substring(value, len(m) + 1, 1000))
        main, sub = F.when(hit, F.lit(m)).otherwise(main), F.when(hit, F.when(rest != "", rest)).otherwise(sub)
    two = F.size(parts) >= 2
    main = F.when(two, F.get(parts, F.lit(0))).otherwise(F.coalesce(main, value))
    sub = F.when(two, F.get(parts, F.lit(1))).otherwise(sub)
    return F.struct(main.alias("main"), sub.alias("sub"))
