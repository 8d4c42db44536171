"""Association between variables: tests against a 0/1 target, categorical and numeric pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.tails import chi2_sf, normal_two_sided, t_two_sided
from riskweave.operators.profile import counts_per_column, per_column
from riskweave.operators.ranks import cut_points, exact_quantiles, prefix_sums, unpivot


def correlation(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation as an aggregate; NULL when either side is constant."""
    spread = F.sqrt(F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def welch_t(df: DataFrame, columns: list[str], target: str, medians: bool = True) -> DataFrame:
    """Class means, medians, difference, Welch t, degrees of freedom and p per column.

    All moments come from one aggregate with a row per (variable, class).
    """
    def of_class(f, c: str, k: int) -> Column:
        return f(F.when(F.col(target) == k, F.col(c)))

    rows = per_column(df, columns, [target], **{
        f"{name}{k}": (lambda c, f=f, k=k: of_class(f, c, k))
        for k in (0, 1)
        for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))})
    e0, e1 = (F.try_divide(F.col(f"var{k}"), F.col(f"n{k}")) for k in (0, 1))
    rows = (rows.withColumn("difference", F.col("mean1") - F.col("mean0"))
            .withColumn("t", F.try_divide(F.col("difference"), F.sqrt(e0 + e1)))
            .withColumn("df", F.try_divide((e0 + e1) ** 2, F.try_divide(
                e0 ** 2, F.col("n0") - 1) + F.try_divide(e1 ** 2, F.col("n1") - 1)))
            .withColumn("p", t_two_sided("t", "df"))
            .select("variable", "mean0", "mean1", "difference", "t", "df", "p"))
    if not medians:
        return rows
    q = exact_quantiles(df, columns, [0.5], by=[target])
    middle = q.groupBy("variable").agg(
        F.max(F.when(F.col(target) == 0, F.col("q")[0])).alias("median0"),
        F.max(F.when(F.col(target) == 1, F.col("q")[0])).alias("median1"))
    return rows.join(middle, "variable")


def mann_whitney(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """U of class 1, AUC = U / (n0 n1), tie-corrected z with continuity and two-sided p.

    One histogram of (variable, distinct value) carries the counts, the ranks and the tie term.
    """
    long = unpivot(df, columns, [target])
    hist = long.groupBy("variable", "value").agg(
        F.sum(F.col(target).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(hist, ["variable"], "value", ["pos", "n"], cut_points(df, columns))
    neg = (F.col("n") - F.col("pos")).cast("double")
    neg_before = (F.col("n_before") - F.col("pos_before")).cast("double")
    n = F.col("n").cast("double")
    sums = ranked.groupBy("variable").agg(
        F.sum(F.col("pos") * (neg_before + neg / 2)).alias("u"),
        F.sum(n * n * n - n).alias("ties"),
        F.max("pos_total").cast("double").alias("n1"),
        F.max("n_total").cast("double").alias("total"))
    n0 = F.col("total") - F.col("n1")
    n0n1 = n0 * F.col("n1")
    larger = F.greatest(F.col("u"), n0n1 - F.col("u"))
    sigma = F.sqrt(n0n1 / 12 * (F.col("total") + 1 - F.try_divide(
        F.col("ties"), F.col("total") * (F.col("total") - 1))))
    return (sums.withColumn("auc", F.try_divide(F.col("u"), n0n1))
            .withColumn("z", F.try_divide(larger - n0n1 / 2 - 0.5, sigma))
            .withColumn("p", F.least(F.lit(1.0), F.when(F.col("z") > 0, normal_two_sided("z"))
                                     .otherwise(1.0)))
            .select("variable", "u", "auc", "z", "p"))


def point_biserial(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Correlation with the 0/1 target, its t statistic and p, skipping missing values."""
    rows = per_column(df, columns, [target], n=F.count, r=lambda c: correlation(
        F.col(c), F.col(target).cast("double")))
    dof = F.col("n") - 2
    return (rows.withColumn("t", F.col("r") * F.sqrt(F.try_divide(dof, 1 - F.col("r") ** 2)))
            .withColumn("p", t_two_sided("t", dof.cast("double"))))


def _cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Contingency cells of several pairs of columns.

    The rows are first reduced to distinct combinations of all columns involved; only those are
    expanded to one row per pair.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    combos = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).groupBy(
        *columns).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(*[F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"),
                                 F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    long = combos.select("n", F.explode(entries).alias("e")).select("n", "e.*")
    return (long.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("var_1", "var_2", "a", "b").agg(F.sum("n").alias("observed")))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Chi-squared without continuity correction and bias-corrected Cramer's V per pair.

    Cells that never occur add their expected count; since all expected counts add up to n, that
    part is n minus the expected counts of the occurring cells, and the grid is never built.
    """
    pair = ["var_1", "var_2"]
    cells = _cells(df, pairs)
    with_margins = cells
    for side, name in (("a", "row_n"), ("b", "col_n")):
        margin = cells.groupBy(*pair, side).agg(F.sum("observed").alias(name))
        with_margins = with_margins.join(margin, [*pair, side])
    totals = cells.groupBy(*pair).agg(
        F.sum("observed").alias("n"), F.count_distinct("a").alias("rows"),
        F.count_distinct("b").alias("cols"))
    expected = F.col("row_n") * F.col("col_n").cast("double") / F.col("n")
    parts = (with_margins.join(totals, pair).withColumn("expected", expected)
             .groupBy(*pair, "n", "rows", "cols").agg(
                 F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("d"),
                 F.sum("expected").alias("covered")))
    r, k, n = F.col("rows"), F.col("cols"), F.col("n")
    chi2 = F.col("d") + F.greatest(F.lit(0.0), n - F.col("covered"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    r_c, k_c = r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)
    return (parts.withColumn("chi2", chi2).withColumn("dof", (r - 1) * (k - 1))
            .withColumn("v", F.sqrt(phi / F.greatest(F.least(k_c - 1, r_c - 1), F.lit(1e-12))))
            .withColumn("p", chi2_sf("chi2", F.col("dof").cast("double")))
            .select(*pair, "n", "dof", "chi2", "v", "p"))


def cramers_v_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cramer's V of every pair of the listed columns."""
    return cramers_v(df, list(combinations(columns, 2)))


def missing_vs_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Target rate with and without a value, and the 2 x 2 chi-squared with Yates' correction."""
    y = F.col(target)
    rows = counts_per_column(
        df, columns,
        n_rows=lambda c: F.count(F.lit(1)),
        n_missing=lambda c: F.count_if(F.col(c).isNull()),
        pos_missing=lambda c: F.sum(F.when(F.col(c).isNull(), y).otherwise(0)),
        pos=lambda c: F.sum(y)).filter((F.col("n_missing") > 0)
                                       & (F.col("n_missing") < F.col("n_rows")))
    n, m, pm, p1 = (F.col(c).cast("double") for c in ("n_rows", "n_missing", "pos_missing", "pos"))
    chi2 = F.lit(0.0)
    for observed, row, col in ((pm, m, p1), (m - pm, m, n - p1), (p1 - pm, n - m, p1),
                               (n - m - (p1 - pm), n - m, n - p1)):
        expected = row * col / n
        # the correction never overshoots the difference
        shrunk = F.abs(observed - expected) - F.least(F.lit(0.5), F.abs(observed - expected))
        chi2 = chi2 + shrunk ** 2 / expected
    return (rows.select(
        "variable", (100.0 * m / n).alias("pct_missing"),
        (100.0 * (p1 - pm) / (n - m)).alias("rate_present"),
        (100.0 * pm / m).alias("rate_missing"), chi2.alias("chi2"))
        .withColumn("difference_pp", F.col("rate_missing") - F.col("rate_present"))
        .withColumn("p", chi2_sf("chi2", F.lit(1.0))))


def _pair_sums(batches, columns: list[str]):
    """Sums over the rows of a partition where both columns of a pair are present."""
    k = len(columns)
    sums = np.zeros((4, k, k))
    for pdf in batches:
        x = pdf.to_numpy(dtype=float)
        seen = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        # [0][i, j]: rows with both; [1], [2]: sum and square sum of i; [3]: sum of i times j
        sums += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
    n, s, q, xy = sums
    i, j = np.triu_indices(k, 1)
    yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i],
                        "sxx": q[i, j], "syy": q[j, i], "sxy": xy[i, j]})


def pearson_pairs(df: DataFrame, columns: list[str], above: float | None = None) -> DataFrame:
    """Pairwise-complete correlation of every pair of columns; NULL when a side is constant.

    Every task reduces its rows to one small matrix of sums (one row per pair), which are then
    added up. Columns are centred at their global means first, so the sums do not cancel.
    """
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    centre = typed.agg(*[F.avg(c).alias(c) for c in columns]).select(
        F.struct(*columns).alias("m")).scalar()
    centred = typed.select(*[(F.col(c) - centre[c]).alias(c) for c in columns])
    sums = centred.mapInPandas(
        lambda batches: _pair_sums(batches, columns),
        "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")

    def spread(square: str, plain: str) -> Column:
        raw = F.col(square) - F.try_divide(F.col(plain) * F.col(plain), n)
        # what is left of a constant column after subtraction is rounding error
        return F.when(raw > 1e-12 * F.col(square), raw)

    shared = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    names = F.array(*[F.lit(c) for c in columns])
    rows = total.select(
        F.get(names, F.col("i")).alias("var_1"), F.get(names, F.col("j")).alias("var_2"),
        F.try_divide(shared, F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))).alias("r"))
    return rows if above is None else rows.filter(F.abs("r") > above)


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of missing flags; columns that are never or always missing have none."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return pearson_pairs(flags, columns).filter(F.col("r").isNotNull())


def eta_squared(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of a numeric column's variance explained by a category, per (category, numeric)."""
    entries = F.array(*[F.struct(
        F.lit(c).alias("category"), F.lit(x).alias("variable"),
        F.col(c).cast("string").alias("level"), F.col(x).cast("double").alias("x"))
        for c, x in pairs])
    long = df.select(F.explode(entries).alias("e")).select("e.*").dropna(subset=["level", "x"])
    # group sums of squares around the group mean, then the exact split of the total
    groups = long.groupBy("category", "variable", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = groups.groupBy("category", "variable").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    return (groups.join(whole, ["category", "variable"]).groupBy("category", "variable").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"))
        .select("category", "variable",
                F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta2")))
