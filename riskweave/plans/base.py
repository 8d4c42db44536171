"""The table every query starts from: orders with a closed status, described by their line items.

Orders play the part of the accounts, the order status that of the outcome text. Only columns the
spec names are read. Line items are reduced to one row per order with a map-side-combined
aggregation before the join, and that aggregate is already distributed by the join key. Customer
and nation sides have unique keys; the engine broadcasts them only when their measured size allows
it and splits a customer that holds a large share of the orders otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.clean import base_table
from riskweave.session import materialise
from riskweave.spec import FeatureSpec

ORDERS = FeatureSpec(
    id="o_orderkey",
    status="o_orderstatus",
    outcomes={"F": 0, "P": 1},
    numeric=["total_price", "ext_price", "n_lines", "quantity", "discount", "tax", "ship_gap",
             "priority_rank", "acct_bal"],
    categorical=["segment", "nation", "region", "priority", "return_flag"],
    digits=["priority_rank"],
    month_gaps={"ship_gap": ["o_orderdate", "first_ship"]},
    month_format=None,
    issue="o_orderdate",
    ranges={"ship_gap": [-48, 48], "acct_bal": [0, 100000]},
    log1p=["total_price", "ext_price"],
    present_flags={"has_lines": "n_lines"},
    missing_flags={"gap_missing": "ship_gap", "priority_missing": "priority_rank",
                   "bal_missing": "acct_bal"},
    merges={"priority": {"from": ["4-NOT SPECIFIED", "5-LOW"], "to": "OTHER"}},
    rare={"return_flag": "OTHER", "nation": "OTHER"},
    rare_share=0.04,
)

NUMERIC = ORDERS.numeric
FLAGS = ORDERS.flags
CATEGORICAL = ORDERS.categorical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Different texts up to which the largest one of a group is found by its place among them.
PLACES = 64


def largest_text(df: DataFrame, name: str) -> Column:
    """``max`` of a text column, as an aggregate that needs no sort of the rows.

    A text in an aggregation buffer makes the engine sort every row by its group. A column of few
    different texts is compared by their places in sorted order; one of more keeps the plain maximum.
    """
    texts = [r[0] for r in df.where(F.col(name).isNotNull()).select(F.col(name).alias("t"))
             .distinct().sort("t").limit(PLACES + 1).collect()]  # at most PLACES + 1 rows
    if not texts or len(texts) > PLACES:
        return F.max(name)
    known = F.array(*[F.lit(t) for t in texts])
    return F.get(known, F.max(F.array_position(known, F.col(name))).cast("int") - 1)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the columns of line item, customer, nation and region the spec refers to."""
    items = table(spark, sf_dir, "lineitem")
    lines = items.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum("l_extendedprice"), 2).alias("ext_price"),
        F.sum("l_quantity").alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
        F.min("l_shipdate").alias("first_ship"),
        largest_text(items, "l_returnflag").alias("last_flag"))
    places = (table(spark, sf_dir, "nation")
              .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", F.col("n_name").alias("nation"),
                      F.col("r_name").alias("region")))
    customers = (table(spark, sf_dir, "customer")
                 .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
                 .select("c_custkey", F.col("c_acctbal").alias("acct_bal"),
                         F.col("c_mktsegment").alias("segment"), "nation", "region"))
    orders = table(spark, sf_dir, "orders")
    return (orders
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .withColumns({
                "total_price": F.col("o_totalprice"),
                "priority": F.col("o_orderpriority"),
                "priority_rank": F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
                                        F.col("o_orderpriority")),
                "return_flag": F.coalesce("last_flag", F.lit("NONE")),
            }))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table(raw_orders(spark, sf_dir), ORDERS)


_PREPARED: dict[tuple[str, str], DataFrame] = {}


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base table, written once per session to the shared folder and read back as Parquet.

    Every later analysis scans only the columns it names from this table instead of repeating the
    joins; the files outlive lost executors.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        _PREPARED[key] = materialise(base(spark, sf_dir), "base")
    return _PREPARED[key]
