"""A streamed panel's distinct users are exact."""

from pyspark.sql import functions as F

from rankpulse.plans import text_queries, text_sql
from rankpulse.streaming import streams


def test_users_are_exact(spark, sf):
    """The query gives the number of users itself, and so does its SQL; also of more users than a sketch counts exactly, and where a state is merged."""
    assert "count(distinct user_id) as n_users" in text_sql.SQL["stream_daily_panel"]
    assert "n_users" in text_queries.stream_daily_panel(spark, sf).columns
    many = spark.range(30_000).select(F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit("a").alias("event_type"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"))
    two = streams.user_state(many.filter("user_id < 20000")).unionByName(streams.user_state(many.filter("user_id >= 10000")))
    assert streams.panel_of_users(two).first().n_users == 30_000
