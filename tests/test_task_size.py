"""Steps whose tasks must not grow with the input: how rows are dealt out, and what a state's rows hold."""

from pyspark.sql import functions as F

from rankpulse.operators import heat, panel, panelstate
from rankpulse.schema import Platform

ROWS = "platform string, rank_family string, rank_sub_cat string, period date, tag_u string, novel_uid long, rank int, heat_raw double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n=200):
    return spark.range(n).selectExpr("'a' as platform", "'x' as rank_family", "'' as rank_sub_cat", "date'2026-01-01' as period", "concat('t', id % 3) as tag_u", "id * 1000003 as novel_uid", "cast(id as int) as rank", "cast(id % 7 as double) as heat_raw")


def test_panel_deals_rows_out_by_item(spark):
    """No copies of all rows for each distinct count, and rows are grouped by item before lists."""
    plan = plan_of(panel.period_panel(rows(spark)))
    assert "Expand" not in plan and "hashpartitioning(novel_uid" in plan


def test_states_of_sparse_items_are_small(spark):
    """Far apart items take a number each, no bitmap of thousands of bits; the panel is that of the rows."""
    state = panelstate.panel_state(rows(spark))
    assert dict(state["items"].dtypes)["items"] == "bigint"
    got, want = panelstate.panel_of(state), panel.period_panel(rows(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_heat_keeps_rows_where_they_are(spark):
    """A frequent figure doesn't put its rows into one task: the rows are not shuffled by figure."""
    df = spark.range(500).select(F.lit("a").alias("platform"), F.when(F.col("id") < 450, 7).otherwise(F.col("id")).alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        assert "SortMergeJoin" not in plan_of(heat.add_heat(df, (Platform("a", "m", True, None),)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
