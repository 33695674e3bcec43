"""The SQL of the corpus operators is SQL, and gives the same rows."""

import decimal

import duckdb
import pytest

from rankpulse.llm import queries


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else repr(v)


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values()) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = ", ".join(sorted(df.columns))
    want = sorted(tuple(map(plain, r)) for r in db.sql(f"select {cols} from ({queries.ORACLES[name]})").fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()) == want
