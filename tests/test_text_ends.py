"""Texts without white space at their ends."""

import re

from pyspark.sql import functions as F

from rankpulse.functions import text as T


def test_strip_takes_what_the_pattern_takes(spark):
    """Every character of the basic plane: at an end it goes if it is white space to Java's pattern, and only then; inside it stays."""
    chars = [(c, f"{chr(c)}a{chr(c)}b{chr(c)}") for c in range(1, 0xD800)]
    df = spark.createDataFrame(chars, "c int, s string")
    assert df.filter(~T.strip(F.col("s")).eqNullSafe(F.regexp_replace("s", r"^(?U)\s+|(?U)\s+$", ""))).count() == 0
    plan = df.select(T.strip(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("regexp_replace", plan)
