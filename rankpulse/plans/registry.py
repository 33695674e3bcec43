"""Named queries and the DuckDB SQL that gives the same rows."""

from rankpulse.plans import star_queries, star_sql, text_queries, text_sql

QUERIES: dict = star_queries.QUERIES | text_queries.QUERIES
ORACLES: dict = star_sql.SQL | text_sql.SQL
