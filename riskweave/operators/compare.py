"""Paired comparison of score sets on the same rows: DeLong, McNemar, bootstrap, Holm."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.clean import effect_band
from riskweave.functions.hashing import strong_draws
from riskweave.functions.tails import binomial_half_two_sided, chi2_sf, normal_two_sided
from riskweave.operators.evaluate import (_rates, auc_of_steps, average_precision_of_steps)
from riskweave.operators.ranks import complete, cut_points, prefix_sums, spread_join
from riskweave.operators.resample import Draws, replicate_metrics
from riskweave.session import materialise

Z975 = 1.959963984540054  # fixed value: 97.5 % point of the standard normal
MARGIN = 0.005            # fixed value: smallest AUC difference called relevant
ALPHA = 0.05


def to_wide(scores: DataFrame, models: list[str], sets: Column | None = None) -> DataFrame:
    """Long scores to one row per observation with a column per score set.

    One aggregate with a row for each observation; ``pivot`` would first group by (observation, set),
    with a shuffle and a hash table of its own. A set's score is the largest of the observation, one
    number in the hash table (``first`` keeps a flag as well, and depends on the order of repeated rows).
    """
    name = F.concat_ws("_", "pipeline", "model") if sets is None else sets
    return scores.withColumn("_set", name).groupBy("id", "label").agg(*[
        F.max(F.when(F.col("_set") == m, F.col("score"))).alias(m)
        for m in models])


def paired_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Guards for pairing two score tables on (id, label): duplicates and one-sided rows."""
    both = left.select("id", "label", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("id", "label", F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy("id", "label").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("paired"),
                   F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"),
                   F.count_if((F.col("l") == 0) | (F.col("r") == 0)).alias("unpaired"))


def require_scores(wide: DataFrame, sets: list[str], label: str) -> None:
    """Refuse rows without a label or without a score of every set: the tests are paired, and a row
    that only some sets have would change the results of the others."""
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in [label, *sets]]) == 1
    if not wide.where(missing).isEmpty():
        raise ValueError("paired tests need a label and a score of every set in every row")


def auc_covariance(wide: DataFrame, sets: list[str], label: str = "label") -> DataFrame:
    """AUCs and their covariance for every pair of score sets (each set with itself included).

    For a positive the component of a score set is the share of negatives it outranks, for a
    negative the share of positives that outrank it, ties half. Rows are first reduced to distinct
    (label, scores) combinations. In long form (set, score) one histogram with keyed running sums
    gives the component of every score of every set and one lookup brings it back, frequent scores
    dealt to several tasks; so the number of shuffles does not depend on the number of sets. The
    components of a combination then meet again, one for each set.
    """
    require_scores(wide, sets, label)
    cuts = cut_points(wide, sets)
    combos = materialise(complete(wide, [label, *sets]).groupBy(label, *sets).agg(
        F.count(F.lit(1)).alias("w")), "combinations")
    long = combos.withColumn("combo", F.monotonically_increasing_id()).select(
        "combo", F.col(label).alias("_y"), "w",
        F.posexplode(F.array(*[F.col(s).cast("double") for s in sets])).alias("set", "score"))
    is_one = F.col("_y") == 1
    hist = long.groupBy("set", "score").agg(
        F.sum(F.when(is_one, F.col("w")).otherwise(0)).alias("pos"),
        F.sum(F.when(is_one, F.lit(0)).otherwise(F.col("w"))).alias("neg"),
        F.count(F.lit(1)).alias("rows"))
    steps = prefix_sums(hist, ["set"], "score", ["pos", "neg"], cuts)
    of_pos = F.try_divide(F.col("neg_before") + F.col("neg") / 2, F.col("neg_total"))
    of_neg = 1 - F.try_divide(F.col("pos_before") + F.col("pos") / 2, F.col("pos_total"))
    steps = materialise(steps.select("set", "score", "rows", of_pos.alias("_p"), of_neg.alias("_n")),
                        "components")
    found = spread_join(long, steps, ["set", "score"], "rows")
    # centred at one half, so that the products below stay small
    value = F.when(is_one, F.col("_p")).otherwise(F.col("_n")) - 0.5
    rows = found.groupBy("combo", "_y", "w").agg(
        F.sort_array(F.collect_list(F.struct("set", value.alias("v")))).getField("v").alias("v"))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i, len(sets))]
    w, v = F.col("w"), F.col("v")
    sums = rows.groupBy("_y").agg(
        F.sum("w").cast("double").alias("n"),
        *[(F.sum(w * v[i]) / F.sum("w")).alias(f"m{i}") for i in range(len(sets))],
        *[F.sum(w * v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs])
    n = F.col("n")
    entries = F.array(*[F.struct(
        F.lit(sets[i]).alias("set_1"), F.lit(sets[j]).alias("set_2"),
        (F.col(f"m{i}") + 0.5).alias("auc_1"), (F.col(f"m{j}") + 0.5).alias("auc_2"),
        F.try_divide(F.col(f"s{i}_{j}") - n * F.col(f"m{i}") * F.col(f"m{j}"), (n - 1) * n)
        .alias("cov")) for i, j in pairs])
    # per class: two rows with every pair, added up over the classes
    return (sums.select("_y", F.inline(entries))
            .groupBy("set_1", "set_2").agg(
                F.max(F.when(is_one, F.col("auc_1"))).alias("auc_1"),
                F.max(F.when(is_one, F.col("auc_2"))).alias("auc_2"),
                F.sum("cov").alias("cov")))


def delong_ci(cov: DataFrame) -> DataFrame:
    """AUC with standard error and 95 % interval per score set, from ``auc_covariance``."""
    se = F.sqrt(F.greatest("cov", F.lit(0.0)))
    return cov.filter(F.col("set_1") == F.col("set_2")).select(
        F.col("set_1").alias("set"), F.col("auc_1").alias("auc"), se.alias("se"),
        (F.col("auc_1") - Z975 * se).alias("low"), (F.col("auc_1") + Z975 * se).alias("high"))


def delong_pairs(cov: DataFrame) -> DataFrame:
    """Difference of two AUCs with interval, z, p and correlation, for every pair of sets."""
    own = cov.filter(F.col("set_1") == F.col("set_2"))
    one = own.select("set_1", F.col("cov").alias("var_1"))
    two = own.select("set_2", F.col("cov").alias("var_2"))
    pairs = (cov.filter(F.col("set_1") != F.col("set_2"))
             .join(one, "set_1").join(two, "set_2"))
    variance = F.col("var_1") + F.col("var_2") - 2 * F.col("cov")
    se = F.sqrt(F.greatest(variance, F.lit(1e-300)))
    return (pairs.withColumn("delta", F.col("auc_1") - F.col("auc_2"))
            .withColumn("se", se)
            .withColumn("z", F.col("delta") / F.col("se"))
            .withColumn("p", normal_two_sided("z"))
            .select("set_1", "set_2", "auc_1", "auc_2", "delta",
                    (F.col("delta") - Z975 * F.col("se")).alias("delta_low"),
                    (F.col("delta") + Z975 * F.col("se")).alias("delta_high"), "z", "p",
                    F.try_divide(F.col("cov"), F.sqrt(F.col("var_1") * F.col("var_2")))
                    .alias("correlation")))


def holm(df: DataFrame, family: list[str], p: str, out: str = "p_holm",
         tie: list[str] = ()) -> DataFrame:
    """Holm-adjusted p inside each family of tests (a result table, not data rows)."""
    order = Window.partitionBy(*family).orderBy(F.asc(p), *[F.asc(t) for t in tie])
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.col(p) * (m - F.row_number().over(order) + 1)
    return (df.withColumn("_step", step)
            .withColumn(out, F.least(F.lit(1.0), F.max("_step").over(
                order.rowsBetween(Window.unboundedPreceding, 0))))
            .drop("_step"))


def with_verdict(tests: DataFrame, p: str = "p_holm", delta: str | None = "delta") -> DataFrame:
    """Significance, relevance, size and a one-word verdict per test."""
    hit = F.col(p) < ALPHA
    out = tests.withColumn("significant", hit)
    if delta is None:
        return out.withColumn("verdict", F.when(hit, "yes").otherwise("no"))
    relevant = F.abs(F.col(delta)) >= MARGIN
    return out.withColumns({
        "relevant": relevant, "size": effect_band(F.col(delta)),
        "verdict": F.when(hit & relevant, "yes (relevant)").when(hit, "yes (not relevant)")
        .otherwise("no")})


def mcnemar(wide: DataFrame, pairs: list[tuple[str, str]], thresholds: Column,
            label: str = "label") -> DataFrame:
    """Agreement counts, statistic and p for pairs of score sets at their own thresholds.

    ``thresholds`` is a map column from set name to threshold (typically a scalar subquery). One
    aggregate counts the cells of every pair in a single pass.
    """
    sets = list(dict.fromkeys(s for pair in pairs for s in pair))
    require_scores(wide, sets, label)
    right = wide.select(*[((F.col(s) >= thresholds[s]).cast("int") == F.col(label)).alias(s)
                          for s in sets])
    counts = right.agg(*[f(F.col(a), F.col(b)).alias(f"{k}{i}")
                         for i, (a, b) in enumerate(pairs) for k, f in (
        ("a", lambda x, y: F.count_if(x & y)), ("b", lambda x, y: F.count_if(x & ~y)),
        ("c", lambda x, y: F.count_if(~x & y)), ("d", lambda x, y: F.count_if(~x & ~y)))])
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("set_1"), F.lit(b).alias("set_2"),
                 *[F.col(f"{k}{i}").alias(k) for k in "abcd"])
        for i, (a, b) in enumerate(pairs)])))
    b, c = F.col("b").cast("double"), F.col("c").cast("double")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return (rows.withColumn("exact", F.col("b") + F.col("c") < 25)
            .withColumn("chi2", F.when(~F.col("exact"), (F.abs(b - c) - 1) ** 2 / (b + c)))
            .withColumn("p", F.coalesce(
                chi2_sf("chi2", F.lit(1.0)),
                binomial_half_two_sided(F.when(F.col("exact"), b), F.when(F.col("exact"), b + c))))
            .withColumn("error_1", (F.col("c") + F.col("d")) / n)
            .withColumn("error_2", (F.col("b") + F.col("d")) / n))


def weighted_metrics(weighted: DataFrame, keys: list[str], cuts: list[float],
                     threshold: Column) -> DataFrame:
    """AUC, average precision and F1 per key from (keys, label, score, weight) rows."""
    hist = weighted.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0)).alias("neg"))
    hist = hist.filter(F.col("pos") + F.col("neg") > 0)
    steps = _rates(prefix_sums(hist, keys, "score", ["pos", "neg"], cuts))
    above = F.col("score") >= threshold
    tp = F.sum(F.when(above, F.col("pos")).otherwise(0))
    fp = F.sum(F.when(above, F.col("neg")).otherwise(0))
    fn = F.sum(F.when(above, F.lit(0)).otherwise(F.col("pos")))
    return steps.groupBy(*keys).agg(
        auc_of_steps().alias("auc"), average_precision_of_steps().alias("ap"),
        (2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1e-300))).alias("f1"))


def bootstrap_paired(wide: DataFrame, pairs: list[tuple[str, str]],
                     thresholds: Column | dict[str, float], replicates: int = 2000, seed: int = 42,
                     uniform: Draws | None = None, label: str = "label",
                     id_col: str = "id") -> DataFrame:
    """Paired bootstrap of the differences in AUC, average precision and F1, see ``resample``.

    ``thresholds`` maps set names to thresholds, as a dict or a map column.
    """
    sets = list(dict.fromkeys(s for pair in pairs for s in pair))
    require_scores(wide, sets, label)
    if isinstance(thresholds, Column):  # one entry per set
        thresholds = wide.sparkSession.range(1).select(thresholds).first()[0]
    per = replicate_metrics(wide, sets, thresholds, replicates,
                            uniform or partial(strong_draws, seed=seed), label, id_col)
    return bootstrap_tests(per, pairs, replicates)


def bootstrap_tests(per: DataFrame, pairs: list[tuple[str, str]], replicates: int) -> DataFrame:
    """Mean, interval and p of the differences of pairs, from metrics per (set, replicate)."""
    sets = list(dict.fromkeys(s for pair in pairs for s in pair))
    values = per.where(F.col("set").isin(sets)).unpivot(
        ["replicate", "set"], ["auc", "ap", "f1"], "metric", "value")
    by_set = values.groupBy("replicate", "metric").pivot("set", sets).agg(F.first("value"))
    differences = by_set.select("replicate", "metric", F.inline(F.array(*[
        F.struct(F.lit(a).alias("set_1"), F.lit(b).alias("set_2"),
                 (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])))
    d = F.when(F.col("replicate") > 0, F.col("d"))
    # at most `replicates` numbers per (pair, metric)
    share_low, share_high = F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double"))
    out = differences.groupBy("set_1", "set_2", "metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("observed"),
        F.avg(d).alias("mean"),
        F.percentile(d, F.lit(0.025)).alias("low"), F.percentile(d, F.lit(0.975)).alias("high"),
        F.greatest(F.lit(1 / replicates), F.least(F.lit(1.0), 2 * F.least(
            share_low, share_high))).alias("p"))
    return out.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def agreement(delong: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """Whether DeLong (unadjusted p) and the bootstrap interval of the AUC decide alike."""
    boot = bootstrap.filter(F.col("metric") == "auc").select("set_1", "set_2", "excludes_0")
    return (delong.select("set_1", "set_2", "delta", (F.col("p") < ALPHA).alias("delong_rejects"))
            .join(boot, ["set_1", "set_2"])
            .withColumn("agree", F.col("delong_rejects") == F.col("excludes_0")))


def three_tests(delong: DataFrame, mcnemar_rows: DataFrame, bootstrap: DataFrame,
                families: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row per family and pair with the Holm-adjusted p and verdict of every test.

    p is adjusted inside each family, separately for every test and metric; without families all
    pairs form one.
    """
    key = ["set_1", "set_2"]
    if families is None:
        listed = delong.select(F.lit("all pairs").alias("family"), *key)
    else:
        listed = delong.sparkSession.createDataFrame(
            [(f, a, b) for f, pairs in families.items() for a, b in pairs],
            "family string, set_1 string, set_2 string")

    def judged(rows: DataFrame, by: list[str], delta: str | None) -> DataFrame:
        tests = listed.join(rows, key)
        return with_verdict(holm(tests, ["family", *by], "p", tie=key), delta=delta)

    dl = judged(delong, [], "delta")
    mc = judged(mcnemar_rows, [], None)
    bs = judged(bootstrap, ["metric"], "mean").groupBy("family", *key).pivot(
        "metric", ["auc", "ap", "f1"]).agg(F.first("p_holm").alias("p"),
                                           F.first("verdict").alias("verdict"))
    on = ["family", *key]
    return (dl.select(*on, "delta", F.col("p_holm").alias("p_delong"),
                      F.col("verdict").alias("delong"))
            .join(mc.select(*on, F.col("p_holm").alias("p_mcnemar"),
                            F.col("verdict").alias("mcnemar")), on)
            .join(bs.select(*on, *[F.col(f"{m}_{v}").alias(f"{w}_{m}") for m in ("auc", "ap", "f1")
                                   for v, w in (("p", "p_bootstrap"), ("verdict", "bootstrap"))]), on))


def all_pairs(sets: list[str]) -> list[tuple[str, str]]:
    return list(combinations(sets, 2))
