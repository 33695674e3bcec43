"""Steps over the star whose tasks must not grow with the tables, and what a report shares."""

from rankpulse.operators import longtable
from rankpulse.plans import registry, star_queries
from rankpulse.sources import shared
from rankpulse.sources.star import facts, star


def test_facts_and_long_rows_take_more_tasks(spark, sf, monkeypatch):
    """With tasks of 500 rows, 6,000 lines take 12 tasks or so, however few shuffle partitions are set."""
    few = facts(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    tables = star(spark, sf)
    assert few <= 4 and facts(spark, sf).rdd.getNumPartitions() >= 10
    plan = longtable.long_table(tables)._jdf.queryExecution().optimizedPlan().toString()
    n = -(-tables["rank_entries"].count() // 500)
    assert n > 4 and "RepartitionByExpression [novel_uid#" in plan and f", {n}" in plan


def test_report_reads_the_star_once(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(star_queries, "star", lambda *a, **k: made.append(1) or star(*a, **k))
    assert registry.QUERIES["report_sections"](spark, sf).count() == 3 and made == [1]
