"""A panel from the states of its days is the panel of its rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rankpulse.operators import panelstate
from rankpulse.operators.panel import period_panel
from rankpulse.streaming import streams

ROWS = "platform string, rank_family string, rank_sub_cat string, period date, tag_u string, cat_u string, novel_uid long, rank int, heat_raw double"


def long_rows(n=1500):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        uid = rng.choice([None, 1, 2, 32768, 32769, *range(3, 60), 70_000_000_001])
        day = datetime.date(2026, 1, 26) + datetime.timedelta(days=rng.randrange(16))
        # a hot topic, topics and lists that are missing, ranks and figures that are missing, negative figures and zero
        topic = rng.choice(["hot"] * 6 + ["a", "b", None, ""])
        out.append((rng.choice(["alpha", None]), rng.choice(["x", "y"]), rng.choice([None, ""]), day, topic, topic or "", uid, rng.choice([None, *range(1, 30)]), rng.choice([None, 0.0, -2.5, float(rng.randrange(90))])))
    return out + out[:40] + [("alpha", "only", "", datetime.date(2026, 1, 30), "bare", "bare", 5, None, None)]


def plain(df):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("dim", ["tag_u", "cat_u"])
def test_merged_panel(spark, dim):
    """By day, week and month, of states in two parts; a merged state can be merged again."""
    df = spark.createDataFrame(long_rows(), ROWS)
    parts = [panelstate.panel_state(df.filter(c), dim) for c in ("coalesce(rank, 0) % 2 = 0", "coalesce(rank, 0) % 2 = 1")]
    state = {name: parts[0][name].unionByName(parts[1][name]) for name in panelstate.STATE}
    for grain in ("day", "week", "month"):
        want = period_panel(df.withColumn("period", F.to_date(F.date_trunc(grain, "period"))), dim)
        got = panelstate.panel_of(state, dim, grain)
        assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
        assert plain(got) == plain(want)
    assert plain(panelstate.panel_of(panelstate.merge_states(state), dim, "month")) == plain(want)
    assert panelstate.panel_of(panelstate.panel_state(df.limit(0), dim), dim).count() == 0


def test_panel_stream(spark, tmp_path):
    """Rows come file by file and the stream starts anew in between; days in several files; a batch that is repeated changes nothing."""
    source, kept, checkpoint = (str(tmp_path / x) for x in ("source", "kept", "checkpoint"))
    data = long_rows(400)
    for k in range(3):
        spark.createDataFrame(data[k::3], ROWS).coalesce(1).write.mode("append").parquet(source)
        if k:
            streams.panel_stream(streams.read_events(spark, source, ROWS, files=1), kept, checkpoint)
    want = plain(period_panel(spark.createDataFrame(data, ROWS).withColumn("period", F.to_date(F.date_trunc("month", "period")))))
    assert plain(panelstate.panel_of(streams.kept_panel(spark, kept), grain="month")) == want
    last = spark.read.schema("batch int").parquet(f"{kept}/items").agg(F.max("batch")).first()[0]
    assert last == 2
