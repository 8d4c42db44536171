"""Deterministic score sets on the base table, in Spark and in SQL.

Two pipelines (a, b) with three models each, or six for the bootstrap and the summary of tests. The scores mix hashed noise with the target and a
measure, and are floored to a grid, so that ties are frequent and every engine computes the same
doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.hashing import portable_uniform
from riskweave.operators.evaluate import youden_threshold
from riskweave.plans.base import prepared
from riskweave.plans.registry import BASE_SQL, portable_sql

SETS = ["a_m1", "a_m2", "a_m3", "b_m1", "b_m2", "b_m3"]
ALL_SETS = [f"{p}_m{k}" for p in "ab" for k in range(1, 7)]


def wide_scores(spark: SparkSession, sf_dir: str, sets: list[str] = SETS) -> DataFrame:
    """(id, label, one column per score set)."""
    b = prepared(spark, sf_dir).select("id", F.col("target").alias("label"), "acct_bal")
    b = b.withColumns({
        **{f"u{k}": portable_uniform(F.col("id"), k) for k in (1, 2, 3, 4)},
        "z": F.coalesce("acct_bal", F.lit(5000.0)) / 10000.0,
        "y": F.col("label").cast("double")})
    u1, u2, u3, u4, z, y = (F.col(c) for c in ("u1", "u2", "u3", "u4", "z", "y"))

    def grid(x, steps: float):
        return F.floor(x * steps) / steps

    scores = {
        "a_m1": grid(0.55 * u1 + 0.25 * y + 0.2 * z, 1000.0),
        "a_m2": grid(0.7 * u1 + 0.2 * y + 0.1 * z, 100.0),
        "a_m3": grid(0.9 * u2 + 0.1 * y, 20.0),
        "a_m4": grid(0.5 * u3 + 0.3 * y + 0.2 * z, 200.0),
        "a_m5": grid(0.8 * u1 + 0.2 * y, 50.0),
        "a_m6": grid(0.85 * u4 + 0.15 * y, 10.0),
        "b_m1": grid(0.5 * u1 + 0.05 * u3 + 0.25 * y + 0.2 * z, 1000.0),
        "b_m2": grid(0.6 * u1 + 0.1 * u3 + 0.2 * y + 0.1 * z, 100.0),
        "b_m3": grid(0.8 * u2 + 0.1 * u3 + 0.1 * y, 20.0),
        "b_m4": grid(0.45 * u3 + 0.05 * u4 + 0.3 * y + 0.2 * z, 200.0),
        "b_m5": grid(0.75 * u1 + 0.05 * u3 + 0.2 * y, 50.0),
        "b_m6": grid(0.8 * u4 + 0.05 * u2 + 0.15 * y, 10.0)}
    return b.select("id", "label", *[scores[s].alias(s) for s in sets])


def long_scores(spark: SparkSession, sf_dir: str, sets: list[str] = SETS) -> DataFrame:
    """(pipeline, model, id, label, score)."""
    entries = F.array(*[F.struct(F.lit(s[0]).alias("pipeline"), F.lit(s[2:]).alias("model"),
                                 F.col(s).alias("score")) for s in sets])
    return wide_scores(spark, sf_dir, sets).select("id", "label", F.inline(entries)).select(
        "pipeline", "model", "id", "label", "score")


def with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``long_scores`` and a margin (pipeline m), whose default threshold is 0."""
    margin = wide_scores(spark, sf_dir, ["a_m1"]).select(
        F.lit("m").alias("pipeline"), F.lit("m1").alias("model"), "id", "label",
        (F.col("a_m1") - 0.5).alias("score"))
    return long_scores(spark, sf_dir).unionByName(margin)


def thresholds(spark: SparkSession, sf_dir: str, sets: list[str] = SETS) -> DataFrame:
    return youden_threshold(long_scores(spark, sf_dir, sets))


def threshold_map(spark: SparkSession, sf_dir: str, sets: list[str] = SETS):
    """Set name -> Youden threshold as a scalar subquery (one map with one entry per set)."""
    rows = thresholds(spark, sf_dir, sets)
    entry = F.struct(F.concat_ws("_", "pipeline", "model"), F.col("threshold"))
    return rows.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def _u(draw: int) -> str:
    return f"{portable_sql('id', str(draw))}::DOUBLE / 2147483647e0"


def _scores_sql(sets: list[str], margin: bool = False) -> str:
    """`wide` and `long`; with `margin` the latter also has m_m1, a score whose default cut is 0."""
    margins = (" UNION ALL SELECT 'm', 'm1', id, label, a_m1 - 0.5e0 FROM wide" if margin else "")
    return BASE_SQL + f""", mixed AS (
SELECT id, target AS label, {_u(1)} AS u1, {_u(2)} AS u2, {_u(3)} AS u3, {_u(4)} AS u4,
       coalesce(acct_bal, 5000e0) / 10000e0 AS z, target::DOUBLE AS y FROM base),
wide AS (SELECT id, label,
  floor((0.55e0 * u1 + 0.25e0 * y + 0.2e0 * z) * 1000e0) / 1000e0 AS a_m1,
  floor((0.7e0 * u1 + 0.2e0 * y + 0.1e0 * z) * 100e0) / 100e0 AS a_m2,
  floor((0.9e0 * u2 + 0.1e0 * y) * 20e0) / 20e0 AS a_m3,
  floor((0.5e0 * u3 + 0.3e0 * y + 0.2e0 * z) * 200e0) / 200e0 AS a_m4,
  floor((0.8e0 * u1 + 0.2e0 * y) * 50e0) / 50e0 AS a_m5,
  floor((0.85e0 * u4 + 0.15e0 * y) * 10e0) / 10e0 AS a_m6,
  floor((0.5e0 * u1 + 0.05e0 * u3 + 0.25e0 * y + 0.2e0 * z) * 1000e0) / 1000e0 AS b_m1,
  floor((0.6e0 * u1 + 0.1e0 * u3 + 0.2e0 * y + 0.1e0 * z) * 100e0) / 100e0 AS b_m2,
  floor((0.8e0 * u2 + 0.1e0 * u3 + 0.1e0 * y) * 20e0) / 20e0 AS b_m3,
  floor((0.45e0 * u3 + 0.05e0 * u4 + 0.3e0 * y + 0.2e0 * z) * 200e0) / 200e0 AS b_m4,
  floor((0.75e0 * u1 + 0.05e0 * u3 + 0.2e0 * y) * 50e0) / 50e0 AS b_m5,
  floor((0.8e0 * u4 + 0.05e0 * u2 + 0.15e0 * y) * 10e0) / 10e0 AS b_m6
  FROM mixed),
long AS ({" UNION ALL ".join(
    f"SELECT '{s[0]}' AS pipeline, '{s[2:]}' AS model, id, label, {s} AS score FROM wide"
    for s in sets)}{margins})
"""


SCORES_SQL = _scores_sql(SETS)
_STEPS = """, hist AS (
SELECT pipeline, model, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg
FROM long GROUP BY 1, 2, 3),
run AS (SELECT *,
  coalesce(sum(pos) OVER w, 0)::BIGINT AS pos_before, coalesce(sum(neg) OVER w, 0)::BIGINT AS neg_before,
  sum(pos) OVER (PARTITION BY pipeline, model)::BIGINT AS p,
  sum(neg) OVER (PARTITION BY pipeline, model)::BIGINT AS n FROM hist
  WINDOW w AS (PARTITION BY pipeline, model ORDER BY score
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
steps AS (SELECT *, p - pos_before AS tp, n - neg_before AS fp,
  (p - pos_before) / p::DOUBLE AS tpr, (n - neg_before) / n::DOUBLE AS fpr,
  (p - pos_before) / (p - pos_before + n - neg_before)::DOUBLE AS prec,
  pos_before + neg_before AS before, pos_before + neg_before + pos + neg AS after FROM run)
"""
STEPS_SQL = SCORES_SQL + _STEPS

_YOUDEN = """, cand AS (
SELECT *, tpr - fpr AS j FROM steps
WHERE least(after * 1000 // (p + n), 999) > least(before * 1000 // (p + n), 999)),
youden AS (SELECT pipeline, model, score AS threshold, j AS youden FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline, model ORDER BY j DESC, score) AS r FROM cand)
  WHERE r = 1)
"""
YOUDEN_SQL = STEPS_SQL + _YOUDEN
MARGIN_YOUDEN_SQL = _scores_sql(SETS, True) + _STEPS + _YOUDEN
#: The same over all twelve score sets.
ALL_YOUDEN_SQL = _scores_sql(ALL_SETS) + _STEPS + _YOUDEN
