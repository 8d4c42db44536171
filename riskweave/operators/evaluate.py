"""Exact threshold and ranking metrics over a score table.

Score tables are long: (pipeline, model, id, label, score). All ranking metrics come from one
histogram per (pipeline, model, distinct score) with running sums; no score is binned and no row
leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranks import cut_points, prefix_sums

KEYS = ["pipeline", "model"]


def score_rows(fitted, df: DataFrame, raw: bool = False, id_col: str = "id",
               label: str = "label") -> DataFrame:
    """Apply a fitted classifier: second element of the probability (or of the raw margin)."""
    column = "rawPrediction" if raw else "probability"
    return fitted.transform(df).select(
        F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
        vector_to_array(F.col(column))[1].alias("score"))


def score_steps(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per distinct score with class counts, counts below it and class totals."""
    hist = scores.groupBy(*keys, "score").agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    return prefix_sums(hist, keys, "score", ["pos", "neg"], cut_points(scores, ["score"]))


def _rates(steps: DataFrame) -> DataFrame:
    """Counts and rates when everything at or above the step's score is called positive."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return steps.withColumns({"tp": tp, "fp": fp, "tpr": F.try_divide(tp, F.col("pos_total")),
                              "fpr": F.try_divide(fp, F.col("neg_total")),
                              "precision": F.try_divide(tp, tp + fp)})


def auc_of_steps() -> Column:
    """Probability that a positive outranks a negative, ties half, as an aggregate over steps."""
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    return F.sum(F.try_divide(F.try_divide(wins, F.col("pos_total")), F.col("neg_total")))


def average_precision_of_steps() -> Column:
    """Sum over steps of recall gained times precision, as an aggregate over rated steps."""
    return F.sum(F.try_divide(F.col("pos"), F.col("pos_total")) * F.col("precision"))


def auc(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return score_steps(scores, keys).groupBy(*keys).agg(auc_of_steps().alias("auc"))


def average_precision(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _rates(score_steps(scores, keys)).groupBy(*keys).agg(
        average_precision_of_steps().alias("average_precision"))


def pr_area_trapezoid(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area under the precision-recall polygon; differs from the step sum when scores tie.

    Between two neighbouring scores the polygon needs the precision of the next higher step, which
    is known from the same row: its counts are those at or above the score minus the row's own.
    """
    steps = _rates(score_steps(scores, keys))
    tp_above, fp_above = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    next_precision = F.when(tp_above + fp_above > 0, tp_above / (tp_above + fp_above)).otherwise(
        F.col("precision"))
    gained = F.try_divide(F.col("pos"), F.col("pos_total"))
    piece = gained * (F.col("precision") + next_precision) / 2
    return steps.groupBy(*keys).agg(F.sum(piece).alias("pr_area"))


def roc_points(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _rates(score_steps(scores, keys)).select(*keys, "score", "fpr", "tpr")


def pr_points(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _rates(score_steps(scores, keys)).select(
        *keys, "score", F.col("tpr").alias("recall"), "precision")


def precision_at_recall(scores: DataFrame, recall: float = 0.5,
                        keys: list[str] = KEYS) -> DataFrame:
    """Precision at the curve point whose recall is nearest, lowest score on ties."""
    points = pr_points(scores, keys)
    nearest = F.struct(F.abs(F.col("recall") - recall), F.col("score"))
    return points.groupBy(*keys).agg(F.min_by(
        F.struct("precision", "recall"), nearest).alias("p")).select(*keys, "p.*")


def youden_threshold(scores: DataFrame, keys: list[str] = KEYS, grid: int = 1000) -> DataFrame:
    """Threshold maximising TPR - FPR over the observed 1/grid ... (grid-1)/grid quantiles.

    A score is one of those quantiles exactly when its cumulative count passes a multiple of
    n/grid, so the candidates are a filter on the score steps. The lowest score wins ties.
    """
    steps = _rates(score_steps(scores, keys))
    n = F.col("pos_total") + F.col("neg_total")
    before = F.col("pos_before") + F.col("neg_before")
    after = before + F.col("pos") + F.col("neg")

    def passed(count: Column) -> Column:
        return F.least(F.floor(count * grid / n), F.lit(grid - 1))

    candidates = steps.filter(passed(after) > passed(before)).withColumn(
        "j", F.col("tpr") - F.col("fpr"))
    best = F.max(F.struct("j", (-F.col("score")).alias("minus"))).alias("b")
    return candidates.groupBy(*keys).agg(best).select(
        *keys, (-F.col("b.minus")).alias("threshold"), F.col("b.j").alias("youden"))


def observed_quantiles(df: DataFrame, column: str, grid: int = 1000) -> DataFrame:
    """Distinct observed quantiles of a column on an even grid, ascending."""
    long = df.select(F.lit(0).alias("_k"), F.col(column).alias("value")).dropna()
    hist = long.groupBy("_k", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = prefix_sums(hist, ["_k"], "value", ["n"], cut_points(df, [column]))

    def passed(count: Column) -> Column:
        return F.least(F.floor(count * grid / F.col("n_total")), F.lit(grid - 1))

    hit = passed(F.col("n_before") + F.col("n")) > passed(F.col("n_before"))
    return steps.filter(hit).select("value")


def confusion(pred: Column, label: Column) -> dict[str, Column]:
    """The four confusion counts as aggregates."""
    return {"tp": F.count_if((pred == 1) & (label == 1)), "fp": F.count_if((pred == 1) & (label == 0)),
            "fn": F.count_if((pred == 0) & (label == 1)), "tn": F.count_if((pred == 0) & (label == 0))}


def with_ratios(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; undefined ratios are 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def metrics_at(scores: DataFrame, thresholds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Confusion counts and ratios per score set and threshold, in one pass over the scores.

    ``thresholds`` has the keys, ``rule`` and ``threshold``: a few rows per model.
    """
    # models x rules rows, each produced by an aggregate over the models
    joined = scores.join(F.broadcast(thresholds), keys)
    pred = (F.col("score") >= F.col("threshold")).cast("int")
    return with_ratios(joined.groupBy(*keys, "rule", "threshold").agg(
        *[c.alias(k) for k, c in confusion(pred, F.col("label")).items()]))


def default_rule(thresholds: DataFrame, keys: list[str] = KEYS,
                 value: float | Column = 0.5) -> DataFrame:
    """The fitted thresholds plus the default one per score set; `value` can be an expression over
    the keys, because margins have their default at 0."""
    fitted = thresholds.select(*keys, F.lit("youden").alias("rule"), "threshold")
    value = value if isinstance(value, Column) else F.lit(value)
    fixed = thresholds.select(*keys, F.lit("default").alias("rule"), value.alias("threshold"))
    return fitted.unionByName(fixed)


def share_flagged(scores: DataFrame, thresholds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    # one row per model
    joined = scores.join(F.broadcast(thresholds), keys)
    return joined.groupBy(*keys).agg(
        F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("share_flagged"))


def metric_table(scores: DataFrame, thresholds: DataFrame, keys: list[str] = KEYS,
                 default: float | Column | None = None) -> DataFrame:
    """AUC, average precision and threshold metrics of every score set side by side, with
    ``default`` also the metrics at the default threshold."""
    steps = _rates(score_steps(scores, keys))
    ranking = steps.groupBy(*keys).agg(
        auc_of_steps().alias("auc"), average_precision_of_steps().alias("average_precision"))
    rules = thresholds.select(*keys, F.lit("youden").alias("rule"), "threshold")
    if default is not None:
        rules = default_rule(thresholds, keys, default)
    return metrics_at(scores, rules, keys).join(ranking, keys)


def metrics_two_routes(scores: DataFrame, thresholds: DataFrame,
                       keys: list[str] = KEYS) -> DataFrame:
    """The same counts from the rows and from the score steps, and their differences."""
    rule = thresholds.select(*keys, F.lit("youden").alias("rule"), "threshold")
    rows = metrics_at(scores, rule, keys).select(*keys, "tp", "fp", "fn", "tn")
    steps = score_steps(scores, keys).join(F.broadcast(thresholds), keys)
    above = F.col("score") >= F.col("threshold")
    other = steps.groupBy(*keys).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp2"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp2"),
        F.sum(F.when(above, F.lit(0)).otherwise(F.col("pos"))).alias("fn2"),
        F.sum(F.when(above, F.lit(0)).otherwise(F.col("neg"))).alias("tn2"))
    gap = reduce(lambda a, b: a + b,
                 [F.abs(F.col(c) - F.col(f"{c}2")) for c in ("tp", "fp", "fn", "tn")])
    return rows.join(other, keys).select(*keys, "tp", "fp", "fn", "tn", gap.alias("difference"))


def hinge_objective(scored: DataFrame, margin: str, label: str, weight_norm2: float = 0.0,
                    cost: float = 1.0) -> DataFrame:
    """Hinge objective of a linear margin next to that of the trivial solution w = 0, b = -1."""
    sign = 2 * F.col(label) - 1
    loss = F.sum(F.greatest(F.lit(0.0), 1 - sign * F.col(margin)))
    trivial = F.sum(F.greatest(F.lit(0.0), 1 + sign))
    return scored.agg((0.5 * F.lit(weight_norm2) + cost * loss).alias("objective"),
                      (cost * trivial).cast("double").alias("trivial"))
