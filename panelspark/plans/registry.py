"""Registry of queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def round_cols(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    """Round all double columns."""
    return df.select(*[
        F.round(c, per_col.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes
    ])


def r(x: str, digits: int = 6) -> str:
    """The same in SQL; adding zero turns -0 into 0."""
    return f"(round({x}, {digits}) + 0e0)"


# Views shared by the SQL statements.
FACTS = """facts AS (
  SELECT l_suppkey AS location, l_linestatus AS sex, l_returnflag AS cause,
         CAST(l_quantity AS INTEGER) AS age, CAST(year(l_shipdate) AS INTEGER) AS year,
         l_linenumber AS code, l_extendedprice AS value, abs(l_discount) AS discount, l_tax AS tax
  FROM lineitem)"""

CELLS = FACTS + """, cells AS MATERIALIZED (
  SELECT location, sex, age, year,
         count(*) FILTER (WHERE cause = 'A') AS n_a,
         count(*) FILTER (WHERE cause = 'N') AS n_n,
         count(*) FILTER (WHERE cause = 'R') AS n_r
  FROM (SELECT location, sex, age, year, cause FROM facts
        UNION ALL
        SELECT s_suppkey, x.sex, CAST(a.age AS INTEGER), CAST(y.year AS INTEGER), NULL
        FROM supplier, (VALUES ('F'), ('O')) x(sex), range(1, 51) a(age), range(1995, 2002) y(year)) u
  GROUP BY location, sex, age, year)"""

CAUSE_ROWS = CELLS + """, cause_rows AS MATERIALIZED (
  SELECT location, sex, age, year, 'A' AS cause, n_a AS n, n_a + n_n + n_r AS tot FROM cells
  UNION ALL SELECT location, sex, age, year, 'N', n_n, n_a + n_n + n_r FROM cells
  UNION ALL SELECT location, sex, age, year, 'R', n_r, n_a + n_n + n_r FROM cells)"""

RATES = CAUSE_ROWS + """, rates AS MATERIALIZED (
  SELECT location, sex, age, year, cause,
         (100e0 + 10e0 * CAST(tot AS DOUBLE)) / 7.3e0 AS nx,
         (n + 1e0) / (tot + 3e0) * 0.1e0 AS prev_rate,
         (n + 1e0) / (tot + 3e0) * 0.01e0 AS dis_mx,
         0.02e0 AS all_mx,
         0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx,
         0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx_all,
         (n + 1e0) / (tot + 3e0) * 0.05e0 AS ir,
         (n + 2e0) / (tot + 4e0) * 0.1e0 AS cf
  FROM cause_rows)"""

STATUS = CELLS + """, status AS MATERIALIZED (
  SELECT location, sex, age, year,
         (n_a + 1) * 100e0 / (n_a + n_n + n_r + 3) AS never,
         (n_n + 1) * 100e0 / (n_a + n_n + n_r + 3) AS current,
         (n_r + 1) * 100e0 / (n_a + n_n + n_r + 3) AS ex,
         (n_n + 1) * 0.2e0 / (n_a + n_n + n_r + 3) AS init,
         (n_r + 1) * 0.3e0 / (n_a + n_n + n_r + 3) AS cess
  FROM cells)"""
