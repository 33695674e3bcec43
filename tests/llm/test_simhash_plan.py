"""The keys under which queries are looked up are many times their rows; they are never sent to the driver."""

from pyspark.sql import functions as F

from rankpulse.llm import simhash


def test_looked_up_keys_are_not_broadcast(spark):
    prints = spark.range(200).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("fingerprint"))
    found = simhash.within(prints, prints.filter("doc_id % 20 = 0"), simhash.NEAR)
    assert found.count() >= 10
    frame = found.groupBy().count()
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_pairs_are_not_broadcast(spark):
    """Of 60 texts with two fingerprints all are near those of their kind; the file of pairs is not sent to the driver."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text that differs in its last word only "), F.col("id") % 2).alias("text"))
    out = simhash.compare(docs)
    assert [r.n_near >= 29 for r in out.filter("doc_id % 20 = 0").collect()] == [True] * 3
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()
