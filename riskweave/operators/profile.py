"""Column profiles over a whole table, each in a fixed number of passes whatever the width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.clean import band, percent
from riskweave.functions.tails import kolmogorov_sf, normal_cdf
from riskweave.operators.ranks import (cut_points, exact_quantiles, few_groups, prefix_sums, stacked,
                                       top_k, unpivot)
from riskweave.operators.split import smallest_hashes

QUARTILES = [0.25, 0.5, 0.75]


def per_column(df: DataFrame, columns: list[str], keep: list[str] = (), **measures) -> DataFrame:
    """One row per numeric column with the given aggregates, all from one scan.

    Each measure maps the name of the value column to an aggregate; ``keep`` columns (a target)
    stay available to it. The columns are unpivoted, so the aggregation buffer has the size of one
    column's measures whatever the width of the table, and stays in generated code.
    """
    long = stacked(df, columns, keep)
    return long.groupBy("variable").agg(*[f("value").alias(m) for m, f in measures.items()])


def counts_per_column(df: DataFrame, columns: list[str], **measures) -> DataFrame:
    """One row per column of any type with a few counting aggregates, from one wide aggregate."""
    aggs = [f(c).alias(f"{m}__{c}") for c in columns for m, f in measures.items()]
    entries = [F.struct(F.lit(c).alias("variable"),
                        *[F.col(f"{m}__{c}").alias(m) for m in measures]) for c in columns]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def table_info(df: DataFrame) -> DataFrame:
    """Type and non-missing count of every column."""
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    info = counts_per_column(df, df.columns, non_null=F.count)
    return info.withColumn("dtype", types[F.col("variable")])


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles and max per numeric column."""
    moments = per_column(
        df, columns, n=F.count, mean=F.avg, std=F.stddev_samp,
        minimum=F.min, maximum=F.max)
    q = exact_quantiles(df, columns, QUARTILES)
    return (moments.join(q, "variable", "left")
            .withColumns({"p25": F.col("q")[0], "p50": F.col("q")[1], "p75": F.col("q")[2]})
            .drop("q"))


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, distinct values, most frequent value (largest on ties) and its frequency."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value").filter(F.col("value").isNotNull())
    cells = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("variable").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"),
        F.max_by("value", F.struct("n", "value")).alias("top"), F.max("n").alias("freq"))


def univariate_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quartiles, 1.5 IQR fences, outliers, skewness, excess kurtosis and missing share."""
    moments = per_column(
        df, columns, n=F.count, mean=F.avg, std=F.stddev_samp, minimum=F.min, maximum=F.max,
        skew=F.skewness, kurt=F.kurtosis, n_rows=lambda c: F.count(F.lit(1)))
    fences = _fences(exact_quantiles(df, columns, QUARTILES))
    # one fence row per listed column: its size is fixed by the argument
    outside = (unpivot(df, columns).join(F.broadcast(fences), "variable")
               .groupBy("variable").agg(F.count_if(
                   (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence")))
                   .alias("n_outliers")))
    return (moments.join(fences, "variable", "left").join(outside, "variable", "left")
            .withColumn("pct_outliers", F.try_divide(F.lit(100.0) * F.col("n_outliers"), F.col("n")))
            .withColumn("pct_missing",
                        F.lit(100.0) * (F.col("n_rows") - F.col("n")) / F.col("n_rows"))
            .drop("n_rows"))


def _fences(quartiles: DataFrame) -> DataFrame:
    q1, q3 = F.col("q")[0], F.col("q")[2]
    reach = F.lit(1.5) * (q3 - q1)
    return quartiles.withColumns({
        "p25": q1, "p50": F.col("q")[1], "p75": q3, "iqr": q3 - q1,
        "low_fence": q1 - reach, "high_fence": q3 + reach}).drop("q")


def log1p_skew(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness before and after log1p; the second is NULL for columns with negative values."""
    rows = per_column(df, columns, skew=F.skewness, minimum=F.min,
                       skew_log=lambda c: F.skewness(F.log1p(F.when(F.col(c) >= 0, F.col(c)))))
    return rows.select("variable", "skew",
                       F.when(F.col("minimum") >= 0, F.col("skew_log")).alias("skew_log1p"))


def normality_screen(df: DataFrame, columns: list[str], money: list[str] = ()) -> DataFrame:
    """Jarque-Bera statistic and p per column from one aggregate, with a scaling recommendation."""
    rows = per_column(df, columns, n=F.count, skew=F.skewness, kurt=F.kurtosis)
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return (rows.withColumn("jarque_bera", jb)
            # the chi-squared tail with two degrees of freedom has a closed form
            .withColumn("p", F.exp(-F.col("jarque_bera") / 2))
            .withColumn("strong_skew", F.abs("skew") > 1)
            .withColumn("recommendation", F.when(F.col("variable").isin(list(money)), "log1p")
                        .otherwise("scale")))


def ks_normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of every column to the normal with its own mean and spread.

    All columns share one histogram of distinct values with running sums. The step function is
    compared with the normal on both sides of each value, so ties need no care. Columns without
    spread are left out.
    """
    moments = per_column(df, columns, mean=F.avg, sd=F.stddev_samp).where("sd > 0")
    hist = unpivot(df, columns).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = prefix_sums(hist, ["variable"], "value", ["n"], cut_points(df, columns))
    # one row per column
    placed = steps.join(F.broadcast(moments), "variable").withColumn(
        "_cdf", normal_cdf((F.col("value") - F.col("mean")) / F.col("sd")))
    total = F.col("n_total")
    gap = F.greatest(F.abs(F.col("n_before") / total - F.col("_cdf")),
                     F.abs((F.col("n_before") + F.col("n")) / total - F.col("_cdf")))
    rows = placed.groupBy("variable").agg(F.max(gap).alias("statistic"),
                                          F.max("n_total").cast("double").alias("_n"))
    return rows.select("variable", "statistic", kolmogorov_sf(F.col("statistic"), F.col("_n"))
                       .alias("p"))


def frequency_table(df: DataFrame, columns: list[str], rare_pct: float = 1.0) -> DataFrame:
    """Count and share of every value (missing included) with a rare flag, for several columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value")
    cells = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("variable").agg(
        F.sum("n").alias("total"), F.count("value").alias("n_categories"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    return (cells.join(totals, "variable")
            .withColumn("pct", percent(F.col("n"), F.col("total")))
            .withColumn("rare", F.round("pct", 2) < rare_pct)
            .withColumn("pct_missing", percent(F.col("n_missing"), F.col("total")))
            .drop("total", "n_missing"))


def cohort_rate(df: DataFrame, cohort: str, target: str) -> DataFrame:
    """Rows and target rate per cohort."""
    return df.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class, and how many rows of the other class there are per row."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # two rows
    return counts.select(target, "n", percent(F.col("n"), total).alias("pct"),
                         (total / F.col("n") - 1).alias("others_per_row"))


def split_audit(df: DataFrame, split: str, target: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("positives"),
                                 F.avg(target).alias("rate"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing count, share and band for every column."""
    rows = counts_per_column(df, df.columns,
                             n_missing=lambda c: F.count_if(F.col(c).isNull()),
                             n_rows=lambda c: F.count(F.lit(1)))
    pct = F.lit(100.0) * F.col("n_missing") / F.col("n_rows")
    # The bands of the missing-data report.
    labels = ["0 %", "(0, 5] %", "(5, 30] %", "(30, 70] %", "> 70 %"]
    return rows.select("variable", "n_missing", pct.alias("pct"),
                       band(pct, [0, 5, 30, 70], labels).alias("band"))


def missing_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Missing share of every column within each group, in long form."""
    wide = df.groupBy(group).agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([group], columns, "variable", "share").withColumn(
        "pct", F.lit(100.0) * F.col("share")).drop("share")


def nulls_per_row(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """How many rows miss how many columns, and the target rate for each count."""
    flags = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    cells = df.select(flags.alias("n_nulls"), target).groupBy("n_nulls").agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most len(columns) + 1 rows
    return cells.withColumn("pct", percent(F.col("n"), total))


def category_risk(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Category x target counts, rate and relative risk; every variable in one shuffle."""
    typed = df.select(target, *[F.col(c).cast("string").alias(c) for c in columns])
    long = typed.unpivot([target], columns, "variable", "category").filter(
        F.col("category").isNotNull())
    cells = long.groupBy("variable", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).cast("long").alias("positives"))
    overall = df.agg(F.avg(target).alias("m")).scalar()
    return (cells.withColumn("negatives", F.col("n") - F.col("positives"))
            .withColumn("rate", F.col("positives") / F.col("n"))
            .withColumn("relative_risk", F.try_divide(F.col("rate"), overall)))


def row_normalised_crosstab(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Share of each class within every category."""
    risk = category_risk(df, columns, target)
    return risk.select("variable", "category", (F.col("negatives") / F.col("n")).alias("share_0"),
                       F.col("rate").alias("share_1"))


def risk_extremes(df: DataFrame, columns: list[str], target: str, k: int = 6) -> DataFrame:
    """The k riskiest and k safest categories of every variable."""
    risk = category_risk(df, columns, target)
    up = top_k(risk, ["variable"], [F.desc("rate"), F.asc("category")], k)
    down = top_k(risk, ["variable"], [F.asc("rate"), F.asc("category")], k)
    return up.withColumn("side", F.lit("high")).unionByName(down.withColumn("side", F.lit("low")))


def histogram(df: DataFrame, columns: list[str], bins: int = 50, upper: float | None = None,
              by: list[str] = (), log: bool = False) -> DataFrame:
    """Equal-width bin counts per column; ``upper`` drops values above that quantile.

    The last bin includes its right edge. Only non-empty bins are listed.
    """
    by = list(by)
    if log:
        df = df.select(*by, *[F.log1p(c).alias(c) for c in columns])
    long = unpivot(df, columns, by)
    if upper is None:
        edges = per_column(df, columns, lo=F.min, hi=F.max)
    else:
        lows = per_column(df, columns, lo=F.min)
        tops = exact_quantiles(df, columns, [upper]).select(
            "variable", F.col("q")[0].alias("cap"))
        capped = long.join(F.broadcast(tops), "variable").filter(F.col("value") <= F.col("cap"))
        highs = capped.groupBy("variable").agg(F.max("value").alias("hi"))
        edges = lows.join(highs, "variable")
    # one row of edges per listed column
    placed = long.join(F.broadcast(edges), "variable").filter(F.col("value") <= F.col("hi"))
    span = F.col("hi") - F.col("lo")
    index = F.when(span > 0, F.least(F.floor((F.col("value") - F.col("lo")) / span * bins),
                                     F.lit(bins - 1))).otherwise(F.lit(0))
    return (placed.groupBy(*by, "variable", "lo", "hi", index.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("left_edge", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins)
            .select(*by, "variable", "bin", "left_edge", "n"))


def box_stats(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside the fences) and outlier count."""
    by = list(by)
    keys = [*by, "variable"]
    few = few_groups(df, by)
    fences = _fences(exact_quantiles(df, columns, QUARTILES, by=by, small_groups=few))
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    # a row for each listed column and group; never the rows, whatever the engine takes them for
    return (unpivot(df, columns, by).join(F.broadcast(fences) if few else fences.hint("merge"), keys)
            .groupBy(*keys).agg(
                F.count(F.lit(1)).alias("n"),
                *[F.first(c).alias(c) for c in ("p25", "p50", "p75")],
                F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
                F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
                F.count_if(~inside).alias("n_outliers")))


def clip_upper(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """Replace values above the p-quantile of their column by that quantile."""
    caps = exact_quantiles(df, columns, [p]).agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.col("q")[0]))).alias("m")).scalar()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c), caps[c]))
                           for c in columns})


def density_curves(df: DataFrame, columns: list[str], by: str, bins: int = 200,
                   points: int = 50) -> DataFrame:
    """Gaussian kernel density per class on a fixed grid, from binned counts of the whole table.

    The rows are reduced to at most columns x classes x bins counts first; the kernel sum then
    runs over those counts and the grid, with Scott's bandwidth.
    """
    counts = histogram(df, columns, bins, by=[by])
    long = unpivot(df, columns, [by])
    spread = long.groupBy(by, "variable").agg(
        F.count(F.lit(1)).alias("total"), F.stddev_samp("value").alias("sd"))
    edges = per_column(df, columns, lo=F.min, hi=F.max)
    width = (F.col("hi") - F.col("lo")) / bins
    cells = (counts.join(spread, [by, "variable"]).join(edges, "variable")
             .withColumn("mid", F.col("left_edge") + width / 2)
             .withColumn("h", F.col("sd") * F.pow(F.col("total"), F.lit(-0.2))))
    grid = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    kernel = F.exp(-0.5 * F.pow((x - F.col("mid")) / F.col("h"), 2)) / (
        F.col("h") * F.sqrt(2 * F.pi()))
    return grid.groupBy(by, "variable", "point").agg(
        F.first(x).alias("x"), F.sum(F.col("n") / F.col("total") * kernel).alias("density"))


def nullity_sample(df: DataFrame, id_col: str, order: str, columns: list[str], sample: Column,
                   n: int) -> DataFrame:
    """Missing flags of a fixed-size random sample, in date order (the sample is the feature).

    Columns without any missing or without any present value tell nothing and are left out.
    """
    some = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n")).first()
    partly = [c for c in columns if 0 < some[c] < some["_n"]]
    picked = smallest_hashes(df, n, id_col, sample)
    return picked.select(id_col, order, *[F.col(c).isNull().cast("int").alias(c) for c in partly]
                         ).orderBy(order, id_col)


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def ingest_audit(raw: DataFrame, id_col: str, status: str) -> DataFrame:
    """Rows whose id is no number, rows without status, and whether they are the same rows."""
    bad_id = F.col(id_col).cast("string").try_cast("long").isNull()
    no_status = F.col(status).isNull()
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad_id).alias("bad_ids"),
                   F.count_if(no_status).alias("empty_status"),
                   F.bool_and(bad_id == no_status).alias("same_rows"))


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys, how many of them repeat, and the most rows one key has."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"),
                       F.count_if(F.col("c") > 1).alias("repeated_keys"),
                       F.max("c").alias("max_rows"))


def key_set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, counted per side."""
    a = left.select(*keys).join(right.select(*keys), keys, "left_anti")
    b = right.select(*keys).join(left.select(*keys), keys, "left_anti")
    return (a.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("left_only"))
            .unionByName(b.agg(F.count(F.lit(1)).alias("n")).withColumn(
                "side", F.lit("right_only"))))


def column_policy(profile: DataFrame, rules: list[tuple[Column, Column | str]],
                  otherwise: str) -> DataFrame:
    """Decision per column: the text of the first rule that holds.

    ``profile`` has ``variable`` and ``pct`` (missing share in percent); a rule is a condition on
    them and the text of its decision.
    """
    decision = F.lit(otherwise)
    for condition, text in reversed(rules):
        text = F.lit(text) if isinstance(text, str) else text
        decision = F.when(condition, text).otherwise(decision)
    return profile.select("variable", F.round("pct", 2).alias("pct"), decision.alias("decision"))


def decisions_count(policy: DataFrame) -> DataFrame:
    """Number of columns per action (the part after the colon)."""
    action = F.trim(F.element_at(F.split("decision", ":"), -1))
    return policy.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def pivot_metrics(long: DataFrame, row: str, column: str, values: list[str],
                  measure: str) -> DataFrame:
    """Long to wide with a known list of output columns (no extra pass to discover them)."""
    return long.groupBy(row).pivot(column, values).agg(F.first(measure))


def replicate(df: DataFrame, times: int) -> DataFrame:
    """The table repeated, with the copy number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def partition_balance(df: DataFrame) -> DataFrame:
    """Rows per partition of a scan."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count(F.lit(1)).alias("n"))
