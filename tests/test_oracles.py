"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from rankpulse.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = db.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(plain, r)) for r in db.sql(f"select {quoted} from ({registry.ORACLES[name]})").fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got == want


def test_every_query_runs(spark, sf):
    missing = set(registry.QUERIES) - set(registry.ORACLES)
    assert missing == {"similarity_match"}
    found = registry.QUERIES["similarity_match"](spark, sf).collect()
    assert all(r["score"] >= 0.7 and r["doc_id"] != r["matched_uid"] for r in found)
