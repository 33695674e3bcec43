"""Panels of categories from entries, without a row for each of an item's tags."""

import pytest
from pyspark.sql import functions as F

from rankpulse.operators import heat, longtable, panel, unify
from rankpulse.plans import registry
from rankpulse.sources import shared
from rankpulse.sources.star import star


def odd(spark, tables):
    """Some items without tags, some without a category, some stored twice, of which a few with another category."""
    novels = tables["novels"].withColumn("main_category", F.when(F.col("novel_uid") % 7 != 0, F.col("main_category")))
    again = novels.filter("novel_uid % 5 = 0").withColumn("main_category", F.when(F.col("novel_uid") % 3 == 0, "other").otherwise(F.col("main_category")))
    return tables | {"novels": novels.unionByName(again), "novel_tag_map": tables["novel_tag_map"].filter("novel_uid % 11 <> 0")}


@pytest.mark.parametrize("grain", ["year", "month"])
def test_counted_panel_is_that_of_the_long_table(spark, sf, grain):
    tables = odd(spark, star(spark, sf, grain=grain))
    category = F.substring_index("main_category", "·", 1)
    rows = heat.add_raw(longtable.long_table(tables)).withColumns({"cat_u": category, "period": unify.period_of("day")})
    want = panel.period_panel(rows, "cat_u")
    got = panel.counted_panel(heat.add_raw(longtable.counted_table(tables, category)))
    assert got.columns == want.columns
    plain = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert plain(got) == plain(want) and got.filter("cat_u is null").count() and got.filter("cat_u = 'other'").count()


@pytest.mark.parametrize("name", ["cross_platform_diff", "cross_platform_both", "category_panel", "category_rollup"])
def test_categories_make_no_row_for_each_tag(spark, sf, monkeypatch, name):
    def long_table(*a, **k):
        raise AssertionError("a long table")

    monkeypatch.setattr(longtable, "long_table", long_table)
    assert registry.QUERIES[name](spark, sf).count()


def test_entries_take_more_tasks(spark, sf, monkeypatch):
    """With tasks of 500 rows entries take as many tasks as that says, also where they meet items."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    tables = star(spark, sf)
    n = -(-tables["rank_entries"].count() // 500)
    assert n > 4 and longtable.counted_table(tables, F.col("main_category")).rdd.getNumPartitions() >= n
