"""Named queries over the given tables, each with the SQL another engine answers it with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def shipped(fn: Query) -> Query:
    """The query, preceded by sending the package to the executors."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a callable (spark, sf_dir) -> DataFrame under a name."""
    def add(fn: Query) -> Query:
        QUERIES[name] = shipped(fn)
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that engines that add in another order agree; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def rounded(*names: str, digits: int = 6) -> str:
    """SQL select list of rounded doubles; 'expr AS name' entries keep their name."""
    out = []
    for n in names:
        expr, _, alias = n.rpartition(" AS ")
        out.append(f"round({expr or n}, {digits}) + 0.0 AS {alias}")
    return ", ".join(out)


# Base table in SQL; the same rules as the Spark specification of the orders.
BASE_SQL = """
WITH li AS (
  SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS ext_price,
         sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount,
         round(avg(l_tax), 6) AS tax, min(l_shipdate) AS first_ship, max(l_returnflag) AS last_flag
  FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT o.*, li.*, c_acctbal, c_mktsegment, n_name, r_name,
         ((year(first_ship) - year(o_orderdate)) * 12 + month(first_ship) - month(o_orderdate))
           ::DOUBLE AS gap
  FROM orders o LEFT JOIN li ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderstatus IN ('F', 'P')),
typed AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END::INTEGER AS target,
         year(o_orderdate)::INTEGER AS issue_year,
         ln(1 + o_totalprice) AS total_price, ln(1 + ext_price) AS ext_price,
         n_lines::DOUBLE AS n_lines, quantity, discount, tax,
         CASE WHEN gap BETWEEN -48 AND 48 THEN gap END AS ship_gap,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
              THEN regexp_extract(o_orderpriority, '([0-9]+)', 1)::DOUBLE END AS priority_rank,
         CASE WHEN c_acctbal BETWEEN 0 AND 100000 THEN c_acctbal END AS acct_bal,
         c_mktsegment AS segment, n_name AS nation, r_name AS region,
         CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'OTHER'
              ELSE o_orderpriority END AS priority,
         coalesce(last_flag, 'NONE') AS return_flag
  FROM raw),
base AS (
  SELECT id, target, issue_year, total_price, ext_price, n_lines, quantity, discount, tax,
         ship_gap, priority_rank, acct_bal,
         (n_lines IS NOT NULL)::INTEGER::DOUBLE AS has_lines,
         (ship_gap IS NULL)::INTEGER::DOUBLE AS gap_missing,
         (priority_rank IS NULL)::INTEGER::DOUBLE AS priority_missing,
         (acct_bal IS NULL)::INTEGER::DOUBLE AS bal_missing,
         segment, nation, region, priority, return_flag
  FROM typed)
"""

NUM = ["total_price", "ext_price", "n_lines", "quantity", "discount", "tax", "ship_gap",
       "priority_rank", "acct_bal"]
FLAG = ["has_lines", "gap_missing", "priority_missing", "bal_missing"]
CAT = ["segment", "nation", "region", "priority", "return_flag"]


def long_sql(columns: list[str], keep: str = "target", source: str = "base",
             missing: bool = False) -> str:
    """Long form (keep, variable, value) of columns."""
    test = "" if missing else " WHERE {c} IS NOT NULL"
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS variable, {c} AS value FROM {source}" + test.format(c=c)
        for c in columns)


NUM_LONG_SQL = BASE_SQL + f", long AS ({long_sql(NUM, 'id, target, issue_year')})"
CAT_LONG_SQL = BASE_SQL + f", long AS ({long_sql(CAT, 'id, target')})"


def simpson_sql(integrand: str, start: str, length: str, steps: int = 4000) -> str:
    return (f"list_sum(list_transform(range(0, {steps + 1}), lambda k : "
            f"(CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
            + integrand.replace("{u}", f"(({start}) + k * ({length}) / {steps}e0)")
            + f")) * ({length}) / {3 * steps}e0")


def normal_p_sql(z: str) -> str:
    """Two-sided normal p by numerical integration of the density."""
    return "2 * " + simpson_sql("exp(-{u} * {u} / 2) / sqrt(2 * pi())", f"abs({z})", "12e0")


def chi2_p_sql(x: str, df: str) -> str:
    return simpson_sql(
        f"exp(({df} - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} * {{u}} / 2 + ln(2) "
        f"- {df} / 2e0 * ln(2) - lgamma({df} / 2e0))", f"sqrt({x})", f"(sqrt({df}) + 12)")


def binomial_p_sql(k: str, n: str) -> str:
    """Two-sided p of k successes in n fair trials."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - ({n}) * ln(2))"
    return (f"least(1e0, 2 * list_sum(list_transform(range(0, least({k}, {n} - ({k})) + 1), "
            f"lambda i : {term})))")


def t_p_sql(t: str, df: str) -> str:
    return "2 * " + simpson_sql(
        f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) "
        f"- ({df} + 1) / 2 * ln(1 + {{u}} * {{u}} / {df}))", f"abs({t})", "16e0")


def portable_sql(row: str, draw: str, seed: int = 42) -> str:
    """The portable integer hash of riskweave.functions.hashing."""
    first = f"(({row} * 7919 + {draw} * 104729 + {seed}) % 2147483647)"
    return f"(((({first} * {first} + 12345) % 2147483647) * 48271) % 2147483647)"
