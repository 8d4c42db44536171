"""Equivalence of two tables or two sets of learned parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.profile import per_column


def table_equivalence(left: DataFrame, right: DataFrame, columns: list[str],
                      tolerance: float = 1e-9) -> DataFrame:
    """Non-missing counts and sums per numeric column on both sides and their difference."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = per_column(df, columns, n=F.count, total=F.sum)
        return rows.select("variable", F.col("n").alias(f"n_{tag}"),
                           F.col("total").alias(f"sum_{tag}"))

    both = side(left, "left").join(side(right, "right"), "variable", "full_outer")
    gap = F.abs(F.col("sum_left") - F.col("sum_right")) / F.greatest(
        F.abs("sum_right"), F.lit(1.0))
    return both.withColumn("relative_gap", gap).withColumn(
        "equal", (F.col("n_left") == F.col("n_right")) & (F.col("relative_gap") <= tolerance))


def category_equivalence(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, categories on either side and how many have different counts."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
            [], columns, "variable", "value")
        return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias(tag))

    a, b = side(left, "n_left").alias("a"), side(right, "n_right").alias("b")
    same = (F.col("a.variable") == F.col("b.variable")) & F.col("a.value").eqNullSafe(
        F.col("b.value"))
    both = a.join(b, same, "full_outer").select(
        F.coalesce("a.variable", "b.variable").alias("variable"), "n_left", "n_right")
    return both.groupBy("variable").agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(~F.col("n_left").eqNullSafe(F.col("n_right"))).alias("different"))


def parameter_differences(left: DataFrame, right: DataFrame, measures: list[str]) -> DataFrame:
    """Absolute and relative differences of learned parameters aligned by variable name."""
    b = right.select("variable", *[F.col(m).alias(f"{m}_right") for m in measures])
    joined = left.select("variable", *measures).join(b, "variable", "full_outer")
    gap = {f"{m}_gap": F.abs(F.col(m) - F.col(f"{m}_right")) for m in measures}
    relative = {f"{m}_relative": F.abs(F.col(m) - F.col(f"{m}_right")) / F.greatest(
        F.abs(m), F.lit(1e-12)) for m in measures}
    return joined.withColumns(gap | relative)
