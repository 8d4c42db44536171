"""Reproducible splits, folds and samples keyed by a hash of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.hashing import HASH_SPACE, strong_hash
from riskweave.operators.ranks import default_buckets


def hash_cuts(df: DataFrame, id_col: str, stratum: str, fractions: list[float],
              order: Column | None = None, space: float = HASH_SPACE) -> DataFrame:
    """Per stratum, the (hash, id) of the round(f x n)-th row in hash order for each fraction.

    The hash is uniform, so its range is cut evenly and rows are only counted per slice; the rows
    of the few slices that hold a cut point are the only ones ranked. Result: one row per stratum
    with an array of cut points, in the order of the fractions.
    """
    order = strong_hash(F.col(id_col)) if order is None else order
    slices = 8 * default_buckets(df.sparkSession)
    keyed = df.select(F.col(stratum).alias("_s"), order.alias("_h"), F.col(id_col).alias("_id"))
    keyed = keyed.withColumn("_b", F.floor(F.col("_h") / space * slices).cast("int"))
    counts = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        "_s", "_b", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_s")).alias("_all"))
    wanted = placed.select("_s", "_b", "_n", "_before", F.posexplode(F.array(*[
        F.round(F.lit(f) * F.col("_all")).cast("long") for f in fractions]))).filter(
        (F.col("col") > F.col("_before")) & (F.col("col") <= F.col("_before") + F.col("_n")))
    # strata x fractions rows
    wanted = F.broadcast(wanted.select("_s", "_b", "_before", F.col("pos"), F.col("col")))
    near = keyed.join(F.broadcast(wanted.select("_s", "_b").distinct()), ["_s", "_b"], "left_semi")
    rank = Window.partitionBy("_s", "_b").orderBy("_h", "_id")
    ranked = near.withColumn("_r", F.row_number().over(rank)).join(wanted, ["_s", "_b"]).filter(
        F.col("_r") + F.col("_before") == F.col("col"))
    return ranked.groupBy("_s").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "_h", "_id"))),
        lambda t: F.struct(t["_h"].alias("h"), t["_id"].alias("id"))).alias("cuts"))


def _passed(df: DataFrame, id_col: str, stratum: str, fractions: list[float],
            order: Column | None, space: float, out: str) -> DataFrame:
    """Number of cut points each row lies beyond; a map-side comparison, no shuffle of the rows."""
    order = strong_hash(F.col(id_col)) if order is None else order
    # one row per stratum
    cuts = F.broadcast(hash_cuts(df, id_col, stratum, fractions, order, space))
    place = F.struct(order.cast("long").alias("h"), F.col(id_col).alias("id"))
    joined = df.join(cuts, F.col(stratum) == F.col("_s"), "left")
    # a cut at rank zero has no row: everything lies beyond it
    beyond = F.when(F.col("cuts").isNull(), F.lit(len(fractions))).otherwise(
        F.size(F.filter("cuts", lambda c: place > c)) + len(fractions) - F.size("cuts"))
    return joined.withColumn(out, beyond).drop("_s", "cuts")


def stratified_split(df: DataFrame, id_col: str = "id", target: str = "target",
                     test_share: float = 0.2, order: Column | None = None,
                     space: float = HASH_SPACE) -> DataFrame:
    """(id, target, split) with exactly round(test_share x n) test rows in every class."""
    return with_stratified_split(df.select(id_col, target), id_col, target, test_share, order, space)


def with_stratified_split(df: DataFrame, id_col: str = "id", target: str = "target",
                          test_share: float = 0.2, order: Column | None = None,
                          space: float = HASH_SPACE) -> DataFrame:
    """All columns of the rows and their split, without the join that a stored split needs."""
    placed = _passed(df, id_col, target, [test_share], order, space, "_k")
    return placed.select(*df.columns, F.when(F.col("_k") == 0, "test").otherwise("train")
                         .alias("split"))


def stratified_folds(df: DataFrame, folds: int = 3, id_col: str = "id", target: str = "target",
                     order: Column | None = None, space: float = HASH_SPACE,
                     out: str = "fold") -> DataFrame:
    """Add a fold number 0..folds-1, of equal size in every class up to rounding."""
    return _passed(df, id_col, target, [i / folds for i in range(1, folds)], order, space, out)


def smallest_hashes(df: DataFrame, n: int, id_col: str, order: Column) -> DataFrame:
    """The n rows with the smallest (hash, id), found by a cut instead of a sort of the rows.

    Rows are counted per leading digits of the hash; the digits below the one that holds the n-th row
    are taken whole, and only that one is ranked. Works for any numeric hash: slices are cut evenly
    between its smallest and largest value.
    """
    slices = 64 * default_buckets(df.sparkSession)
    keyed = df.withColumn("_h", order)
    ends = keyed.agg(F.min("_h").cast("double").alias("low"), F.max("_h").cast("double").alias("high"))
    low, high = (ends.select(c).scalar() for c in ("low", "high"))
    share = (F.col("_h").cast("double") - low) / F.greatest(high - low, F.lit(1e-300))
    keyed = keyed.withColumn("_slice", F.least(F.floor(share * slices), F.lit(slices - 1)).cast("int"))
    counts = keyed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each slice
    placed = counts.withColumn("_end", F.sum("_n").over(upto)).where(
        F.col("_end") - F.col("_n") < n).agg(F.max("_slice").alias("last"), F.max(F.struct(
            "_slice", (F.col("_end") - F.col("_n")).alias("before"))).alias("top"))
    last, before = placed.select("last").scalar(), placed.select("top.before").scalar()
    edge = keyed.where(F.col("_slice") == last)
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", id_col))
    picked = edge.withColumn("_r", rank).where(F.col("_r") <= n - before).drop("_r")
    return keyed.where(F.col("_slice") < last).unionByName(picked).drop("_h", "_slice")


def hash_sample(df: DataFrame, n: int, id_col: str = "id", order: Column | None = None) -> DataFrame:
    """Simple random sample of n rows: the n smallest hashes, independent of the partitioning."""
    return smallest_hashes(df, n, id_col, strong_hash(F.col(id_col)) if order is None else order)


def fraction_sample(df: DataFrame, fraction: float, id_col: str = "id",
                    order: Column | None = None, space: float = HASH_SPACE) -> DataFrame:
    """Every row whose hash falls in the first ``fraction`` of the range; a plain filter."""
    order = strong_hash(F.col(id_col)) if order is None else order
    return df.filter(order < fraction * space)


def every_kth(df: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Rows whose id is a multiple of k: the same subset in every pipeline."""
    return df.filter(F.pmod(F.col(id_col), F.lit(k)) == 0)


def attach_split(df: DataFrame, split: DataFrame, id_col: str = "id") -> DataFrame:
    """Inner join of the stored (id, split) contract."""
    return df.join(split.select(id_col, "split"), id_col)


def only(df: DataFrame, part: str) -> DataFrame:
    return df.filter(F.col("split") == part).drop("split")
