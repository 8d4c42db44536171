"""Distributed ranking: value histograms, global running sums, exact quantiles.

A window ordered over a whole table runs in one task, and Spark's exact ``percentile`` (like
``approxQuantile`` with error 0) keeps every distinct value in one buffer. Everything here that
needs a global order instead

1. reduces rows to one per distinct value with a map-side-combined ``groupBy`` (so a value that
   holds a third of the rows costs one row),
2. cuts the value axis at approximate quantiles, which only balance the work and never change a
   result,
3. runs the ordered window inside (key, bucket) and adds the bucket offsets, a table of at most
   keys x buckets rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

MAX_BUCKETS = 20_000
#: Groups up to which a table with a few rows for each group and column is broadcast.
SMALL_GROUPS = 1000


def default_buckets(spark: SparkSession) -> int:
    """As many value buckets as shuffle partitions, so the ordered step uses every executor."""
    return min(MAX_BUCKETS, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, columns: list[str], buckets: int | None = None,
               share: float = 0.01) -> list[float]:
    """Distinct approximate quantiles of the columns, pooled: at most columns x buckets numbers.

    Cuts only balance the ordered step, so a share of the rows is enough to place them: a small
    table then gets few cuts or none and stays in few tasks, a large one gets all of them. Every
    row is still counted and ranked. Pooling keeps one set of cuts for several columns or keys;
    each column is cut at least as finely as by its own quantiles.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return []
    seen = df.select(*columns).sample(fraction=share, seed=7) if share < 1 else df
    found = seen.approxQuantile(columns, probs, 1 / (4 * buckets))
    return sorted({value for values in found for value in values})


def with_bucket(df: DataFrame, value: str, cuts: list[float], out: str = "_bucket") -> DataFrame:
    """Add the index of the half-open interval [cut, next cut) the value lies in."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=value, outputCol=out,
                        handleInvalid="keep").transform(df)
    # never NULL, so that joins on it add no filter and both users of a histogram share one scan
    return placed.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def stacked(df: DataFrame, columns: list[str], keep: list[str] = (), name: str = "variable",
            value: str = "value", cast: str = "double") -> DataFrame:
    """Long form of columns, missing values included.

    Written with ``inline``: unlike the plan of ``DataFrame.unpivot``, two uses of it compare as
    equal, so a shuffle above it is computed once.
    """
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value))
                        for c in columns])
    return df.select(*keep, F.inline(entries))


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = (), name: str = "variable",
            value: str = "value") -> DataFrame:
    """Long form of numeric columns, without the missing values."""
    return stacked(df, columns, keep, name, value).filter(F.col(value).isNotNull())


def few_groups(df: DataFrame, by: list[str]) -> bool:
    """Whether a table with a few rows for each group may be broadcast."""
    return not by or df.select(*by).distinct().limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all the columns are present.

    Plain null tests, not ``dropna``: the optimizer then knows that later joins on the columns need
    no filter of their own, and two uses of the table keep the same plan.
    """
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def value_histogram(df: DataFrame, keys: list[str], value: str,
                    measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, distinct value) with the summed measures (default: the row count)."""
    measures = measures or {"n": F.count(F.lit(1))}
    return df.groupBy(*keys, value).agg(*[m.alias(k) for k, m in measures.items()])


def prefix_sums(hist: DataFrame, keys: list[str], value: str, measures: list[str],
                cuts: list[float]) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values) and ``<m>_total`` per key to a histogram.

    Rows without a value or with a missing key are left out. The histogram is used twice, for the
    offsets and for the ordered step; the engine computes its shuffle once.
    """
    h = with_bucket(complete(hist, [*keys, value]), value, cuts)
    sums = h.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    earlier = (Window.partitionBy(*keys).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)
    # renamed keys keep both sides of the join on the very same histogram, so its shuffle is reused
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_bucket"])}
    offsets = sums.select(
        *[F.col(k).alias(n) for k, n in names.items()],
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"{m}_total") for m in measures])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumns({f"_i_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    same = [F.col(k) == F.col(n) for k, n in names.items()]
    return (h.join(offsets, same)
            .withColumns({f"{m}_before": F.col(f"_i_{m}") + F.col(f"_o_{m}") for m in measures})
            .drop("_bucket", *names.values(), *[f"_i_{m}" for m in measures],
                  *[f"_o_{m}" for m in measures]))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str,
                how: str = "inner") -> DataFrame:
    """Join rows to a table that is unique on the keys and says how many rows have them (`count`).

    Keys with more rows than an equal share of the tasks are dealt to several tasks by the rows'
    place, and their one row of the table is copied to each; there are fewer such keys than shares,
    so their list can be broadcast. Nothing is left to adaptive execution. The table is read three
    times, so it should be a written one.
    """
    total = table.agg(F.sum(count)).scalar()
    share = F.greatest(F.lit(1), F.ceil(total / default_buckets(rows.sparkSession)))
    parts = F.ceil(F.col(count) / share).cast("int")
    heavy = F.broadcast(table.where(F.col(count) > share).select(*keys, parts.alias("_parts")))
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).join(heavy, keys, "left")
    dealt = placed.withColumn("_part", F.pmod(
        "_place", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_place", "_parts")
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def rank_table(df: DataFrame, value: str, keys: list[str] = (), out: str = "avg_rank",
               percent: bool = False, count: str | None = None) -> DataFrame:
    """Rank 1..n with ties averaged (optionally divided by n) of every distinct value; with
    ``count`` also the number of rows that have it."""
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    ranked = prefix_sums(value_histogram(present, keys, value), keys, value, ["n"],
                         cut_points(df, [value]))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    return ranked.select(*keys, value, (rank / F.col("n_total") if percent else rank).alias(out),
                         *([F.col("n").alias(count)] if count else []))


def average_rank(df: DataFrame, value: str, keys: list[str] = (), out: str = "avg_rank",
                 percent: bool = False) -> DataFrame:
    """``rank_table`` joined back to the rows; a value with many rows is split over tasks."""
    table = materialise(rank_table(df, value, keys, out, percent, count="_rows"), "ranks")
    return spread_join(df, table, [*keys, value], "_rows", "left").drop("_rows")


def _targets(probs: list[float], total: Column, method: str) -> Column:
    """Zero-based order statistics each probability needs and their share in the result."""
    listed = F.array(*[F.lit(float(p)) for p in probs])
    if method == "observed":
        return F.transform(listed, lambda p, i: F.struct(
            i.alias("i"), F.greatest(F.ceil(F.round(p * total, 9)) - 1, F.lit(0)).alias("at"),
            F.lit(1.0).alias("share")))
    place = F.transform(listed, lambda p, i: F.struct(i.alias("i"), (p * (total - 1)).alias("x")))
    return F.flatten(F.transform(place, lambda t: F.array(
        F.struct(t["i"].alias("i"), F.floor(t["x"]).alias("at"),
                 (1 - t["x"] + F.floor(t["x"])).alias("share")),
        F.struct(t["i"].alias("i"), (F.floor(t["x"]) + 1).alias("at"),
                 (t["x"] - F.floor(t["x"])).alias("share")))))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (),
                    method: str = "linear", small_groups: bool = True,
                    cuts: list[float] | None = None) -> DataFrame:
    """Exact quantiles: one row per (by, variable) with an array ``q`` in the order of ``probs``.

    ``method="linear"`` interpolates between order statistics; ``"observed"`` takes the smallest
    value whose cumulative share reaches p. Rows are first only counted per bucket; then just the
    buckets that contain a wanted order statistic are histogrammed and ordered. With
    ``small_groups`` (a class label, a category, see ``few_groups``) the list of wanted buckets, at
    most 2 x probs x columns x groups rows, is broadcast so that other rows never reach a shuffle;
    otherwise both sides are shuffled. The choice is not left to the engine: it estimates the rows
    before their columns are stacked, takes them for the smaller side and broadcasts them.
    """
    by = list(by)
    keys = [*by, "variable"]
    cuts = cut_points(df, columns) if cuts is None else cuts
    long = with_bucket(unpivot(df, columns, by), "value", cuts)
    counts = long.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_nb"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *keys, "_bucket", "_nb",
        F.coalesce(F.sum("_nb").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_nb").over(Window.partitionBy(*keys)).alias("_total"))

    def between(low: Column, high: Column) -> Column:
        """Wanted order statistics at places low <= place < high."""
        return F.filter(_targets(probs, F.col("_total"), method),
                        lambda t: (t["at"] >= low) & (t["at"] < high) & (t["share"] > 0))

    start = F.col("_start")
    wanted = placed.filter(F.size(between(start, start + F.col("_nb"))) > 0).drop("_nb")
    # without keys beyond the variable names the table is bounded by the arguments alone
    wanted = F.broadcast(wanted) if small_groups or not by else wanted.hint("merge")
    # _start and _total depend on (keys, _bucket) and are carried through the grouping
    near = long.join(wanted, [*keys, "_bucket"])
    hist = near.groupBy(*keys, "_bucket", "_start", "_total", "value").agg(
        F.count(F.lit(1)).alias("n"))
    upto = (Window.partitionBy(*keys, "_bucket").orderBy("value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("_end", start + F.sum("n").over(upto))
    picked = hist.select(*keys, "value", F.explode(
        between(F.col("_end") - F.col("n"), F.col("_end"))).alias("t"))
    # at most two order statistics per probability
    parts = picked.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("t.i").alias("i"), (F.col("value") * F.col("t.share")).alias("v"))).alias("_parts"))
    quantile = F.transform(
        F.sequence(F.lit(0), F.lit(len(probs) - 1)),
        lambda i: F.aggregate(F.filter("_parts", lambda s: s["i"] == i), F.lit(0.0),
                              lambda total, s: total + s["v"]))
    return parts.select(*keys, quantile.alias("q"))


def extreme_rows(df: DataFrame, group: str, measure: str, id_col: str, lowest: bool) -> DataFrame:
    """Id of the extreme row per group, smallest id on ties."""
    order = F.struct(F.col(measure) if lowest else -F.col(measure), F.col(id_col))
    return df.groupBy(group).agg(F.min_by(F.struct(id_col, measure), order).alias("r")).select(
        group, "r.*")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; the engine keeps only k candidates per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def best_excluding(df: DataFrame, group: list[str], order: list[Column], name: str,
                   excluded: str) -> DataFrame:
    """The first row per group among those with another name than `excluded`."""
    return top_k(df.where(F.col(name) != excluded), group, order, 1).drop("rank")


def head_and_tail(df: DataFrame, group: list[str], order: list[Column], reverse: list[Column],
                  k: int) -> DataFrame:
    """First k and last k rows per group of a sorted table; short groups list a row on both sides."""
    head = top_k(df, group, order, k, "rank").withColumn("side", F.lit("head"))
    tail = top_k(df, group, reverse, k, "rank").withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


def competition_rank(df: DataFrame, group: list[str], measure: Column, out: str = "rank") -> DataFrame:
    """Rank of grid points by score; equal scores share the smaller rank."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*group).orderBy(measure)))
