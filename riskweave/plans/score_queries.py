"""Threshold and ranking metrics, paired comparison and explanations over score sets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskweave.functions.hashing import portable_draws
from riskweave.operators import compare, evaluate, explain, profile, ranks
from riskweave.plans.base import prepared
from riskweave.plans.registry import (binomial_p_sql, chi2_p_sql, normal_p_sql, portable_sql, query,
                                      rounded, tidy)
from riskweave.plans.scores import (ALL_SETS, ALL_YOUDEN_SQL, MARGIN_YOUDEN_SQL, SCORES_SQL, SETS,
                                    STEPS_SQL, YOUDEN_SQL, long_scores, threshold_map, thresholds,
                                    wide_scores, with_margin)

_AUC = "sum(pos * (neg_before + neg / 2e0) / p / n)"
_AP = "sum(pos / p::DOUBLE * prec)"


@query("auc_exact", STEPS_SQL + f"""SELECT pipeline, model, {rounded(_AUC + ' AS auc')}
FROM steps GROUP BY 1, 2""")
def auc_exact(spark, sf):
    return tidy(evaluate.auc(long_scores(spark, sf)))


@query("average_precision", STEPS_SQL + f"""
SELECT pipeline, model, {rounded(_AP + ' AS average_precision')} FROM steps GROUP BY 1, 2""")
def average_precision(spark, sf):
    return tidy(evaluate.average_precision(long_scores(spark, sf)))


@query("pr_area_trapezoid", STEPS_SQL + f""", nb AS (SELECT *,
  coalesce(lead(prec) OVER (PARTITION BY pipeline, model ORDER BY score), prec) AS above FROM steps)
SELECT pipeline, model, {rounded('sum(pos / p::DOUBLE * (prec + above) / 2) AS pr_area')}
FROM nb GROUP BY 1, 2""")
def pr_area_trapezoid(spark, sf):
    return tidy(evaluate.pr_area_trapezoid(long_scores(spark, sf)))


@query("roc_points", STEPS_SQL + f"SELECT pipeline, model, {rounded('score', 'fpr', 'tpr')} FROM steps")
def roc_points(spark, sf):
    return tidy(evaluate.roc_points(long_scores(spark, sf)))


@query("pr_points", STEPS_SQL + f"""
SELECT pipeline, model, {rounded('score', 'tpr AS recall', 'prec AS precision')} FROM steps""")
def pr_points(spark, sf):
    return tidy(evaluate.pr_points(long_scores(spark, sf)))


@query("precision_at_recall", STEPS_SQL + f""", r AS (SELECT *, row_number() OVER (
  PARTITION BY pipeline, model ORDER BY abs(tpr - 0.5e0), score) AS k FROM steps)
SELECT pipeline, model, {rounded('prec AS precision', 'tpr AS recall')} FROM r WHERE k = 1""")
def precision_at_recall(spark, sf):
    return tidy(evaluate.precision_at_recall(long_scores(spark, sf)))


@query("youden_threshold", YOUDEN_SQL + f"""
SELECT pipeline, model, {rounded('threshold', 'youden')} FROM youden""")
def youden_threshold(spark, sf):
    return tidy(thresholds(spark, sf))


_METRICS = """, rules AS (
SELECT pipeline, model, 'youden' AS rule, threshold FROM youden
UNION ALL SELECT pipeline, model, 'default', CASE WHEN pipeline = 'm' THEN 0e0 ELSE 0.5e0 END
FROM youden),
c AS (SELECT pipeline, model, rule, threshold,
  count(*) FILTER (score >= threshold AND label = 1) AS tp,
  count(*) FILTER (score >= threshold AND label = 0) AS fp,
  count(*) FILTER (score < threshold AND label = 1) AS fn,
  count(*) FILTER (score < threshold AND label = 0) AS tn
  FROM long JOIN rules USING (pipeline, model) GROUP BY 1, 2, 3, 4)
"""
_METRICS_SQL = YOUDEN_SQL + _METRICS
_RATIOS = ("(tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy",
           "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision",
           "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall",
           "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1")


@query("metrics_at_threshold", MARGIN_YOUDEN_SQL + _METRICS + f"""
SELECT pipeline, model, rule, tp, fp, fn, tn, {rounded('threshold', *_RATIOS)} FROM c""")
def metrics_at_threshold(spark, sf):
    """Probabilities have their default threshold at one half, the margin of pipeline m at 0."""
    scores = with_margin(spark, sf)
    rules = evaluate.default_rule(evaluate.youden_threshold(scores), value=F.when(
        F.col("pipeline") == "m", 0.0).otherwise(0.5))
    return tidy(evaluate.metrics_at(scores, rules))


@query("share_flagged", YOUDEN_SQL + f"""
SELECT pipeline, model, {rounded('avg((score >= threshold)::INTEGER) AS share_flagged')}
FROM long JOIN youden USING (pipeline, model) GROUP BY 1, 2""")
def share_flagged(spark, sf):
    return tidy(evaluate.share_flagged(long_scores(spark, sf), thresholds(spark, sf)))


@query("metric_table", _METRICS_SQL + f""", a AS (
SELECT pipeline, model, {_AUC} AS auc, {_AP} AS average_precision FROM steps GROUP BY 1, 2)
SELECT pipeline, model, rule, tp, fp, fn, tn, {rounded('threshold', *_RATIOS, 'auc', 'average_precision')}
FROM c JOIN a USING (pipeline, model) WHERE rule = 'youden'""")
def metric_table(spark, sf):
    return tidy(evaluate.metric_table(long_scores(spark, sf), thresholds(spark, sf)))


@query("metric_pivot", STEPS_SQL + f""", a AS (
SELECT pipeline, model, {_AUC} AS auc FROM steps GROUP BY 1, 2)
SELECT model, {rounded("max(auc) FILTER (pipeline = 'a') AS a", "max(auc) FILTER (pipeline = 'b') AS b")}
FROM a GROUP BY 1""")
def metric_pivot(spark, sf):
    return tidy(profile.pivot_metrics(evaluate.auc(long_scores(spark, sf)), "model", "pipeline",
                                      ["a", "b"], "auc"))


@query("metrics_two_routes", _METRICS_SQL + """
SELECT pipeline, model, tp, fp, fn, tn, 0::BIGINT AS difference FROM c WHERE rule = 'youden'""")
def metrics_two_routes(spark, sf):
    return evaluate.metrics_two_routes(long_scores(spark, sf), thresholds(spark, sf))


@query("top2_models", STEPS_SQL + f""", a AS (
SELECT pipeline, model, {_AUC} AS auc FROM steps GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY auc DESC, model) AS k FROM a)
SELECT pipeline, model, {rounded('auc')}, k::INTEGER AS "rank" FROM r WHERE k <= 2""")
def top2_models(spark, sf):
    return tidy(ranks.top_k(evaluate.auc(long_scores(spark, sf)), ["pipeline"],
                            [F.desc("auc"), F.asc("model")], 2))


@query("best_model_excluding", STEPS_SQL + f""", a AS (
SELECT pipeline, model, {_AUC} AS auc FROM steps WHERE model <> 'm1' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY auc DESC, model) AS k FROM a)
SELECT pipeline, model, {rounded('auc')} FROM r WHERE k = 1""")
def best_model_excluding(spark, sf):
    """Best model of each pipeline besides one that is compared with it."""
    return tidy(ranks.best_excluding(evaluate.auc(long_scores(spark, sf)), ["pipeline"],
                                     [F.desc("auc"), F.asc("model")], "model", "m1"))


@query("paired_observations", SCORES_SQL + """
SELECT count(*) AS paired, 0::BIGINT AS repeated, 0::BIGINT AS unpaired FROM wide""")
def paired_observations(spark, sf):
    long = long_scores(spark, sf).filter(F.col("model") == "m1")
    return compare.paired_check(long.filter(F.col("pipeline") == "a"),
                                long.filter(F.col("pipeline") == "b"))


@query("scores_long_to_wide", SCORES_SQL + f"SELECT id, label, {', '.join(SETS)} FROM wide")
def scores_long_to_wide(spark, sf):
    return compare.to_wide(long_scores(spark, sf), SETS)


_PAIRS = compare.all_pairs(SETS)
_COV = ", comp AS (SELECT id, label, pipeline || '_' || model AS s, " \
    "CASE WHEN label = 1 THEN (neg_before + neg / 2e0) / n ELSE 1 - (pos_before + pos / 2e0) / p END AS v " \
    "FROM long JOIN steps USING (pipeline, model, score))" + """,
pairs AS (SELECT x.s AS set_1, y.s AS set_2, x.label AS label, covar_samp(x.v, y.v) / count(*) AS c,
  avg(x.v) AS m1, avg(y.v) AS m2 FROM comp x JOIN comp y USING (id) WHERE x.s <= y.s GROUP BY 1, 2, 3),
cov AS (SELECT set_1, set_2, sum(c) AS cov, max(m1) FILTER (label = 1) AS auc_1,
  max(m2) FILTER (label = 1) AS auc_2 FROM pairs GROUP BY 1, 2)
"""
_COV_SQL = STEPS_SQL + _COV
_Z = "1.959963984540054e0"


@query("auc_covariance", _COV_SQL + f"""
SELECT set_1, set_2, {rounded('auc_1', 'auc_2', digits=6)}, {rounded('cov * 1e6 AS cov_e6', digits=4)}
FROM cov""")
def auc_covariance(spark, sf):
    cov = compare.auc_covariance(wide_scores(spark, sf), SETS)
    return cov.select("set_1", "set_2", F.round("auc_1", 6).alias("auc_1"),
                      F.round("auc_2", 6).alias("auc_2"),
                      F.round(F.col("cov") * 1e6, 4).alias("cov_e6"))


@query("delong_ci", _COV_SQL + f"""
SELECT set_1 AS "set", {rounded('auc_1 AS auc', 'sqrt(cov) AS se',
    f'auc_1 - {_Z} * sqrt(cov) AS low', f'auc_1 + {_Z} * sqrt(cov) AS high')}
FROM cov WHERE set_1 = set_2""")
def delong_ci(spark, sf):
    return tidy(compare.delong_ci(compare.auc_covariance(wide_scores(spark, sf), SETS)))


_DELONG = f""", d AS (SELECT c.set_1, c.set_2, c.auc_1, c.auc_2, c.auc_1 - c.auc_2 AS delta,
  a.cov AS v1, b.cov AS v2, c.cov AS cv, sqrt(greatest(a.cov + b.cov - 2 * c.cov, 1e-300)) AS se
  FROM cov c JOIN cov a ON a.set_1 = c.set_1 AND a.set_2 = c.set_1
  JOIN cov b ON b.set_1 = c.set_2 AND b.set_2 = c.set_2 WHERE c.set_1 <> c.set_2),
delong AS (SELECT *, delta / se AS z, {normal_p_sql('(delta / se)')} AS p,
  delta - {_Z} * se AS delta_low, delta + {_Z} * se AS delta_high,
  cv / sqrt(v1 * v2) AS correlation FROM d)
"""
_DELONG_SQL = _COV_SQL + _DELONG


def _delong(spark, sf, sets=SETS):
    return compare.delong_pairs(compare.auc_covariance(wide_scores(spark, sf, sets), sets))


@query("delong_pairs", _DELONG_SQL + f"""
SELECT set_1, set_2, {rounded('auc_1', 'auc_2', 'delta', 'delta_low', 'delta_high', 'p', 'correlation')},
       {rounded('z', digits=4)} FROM delong""")
def delong_pairs(spark, sf):
    return tidy(_delong(spark, sf).withColumn("z", F.round("z", 4)))


def _holm_sql(source: str, family: str, p: str = "p") -> str:
    return f"""SELECT *, least(1e0, max(step) OVER (PARTITION BY {family} ORDER BY {p}, set_1, set_2
  ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (
  SELECT *, {p} * (count(*) OVER (PARTITION BY {family}) - row_number() OVER (
    PARTITION BY {family} ORDER BY {p}, set_1, set_2) + 1) AS step FROM {source})"""


_HOLM_FAMILIES_SQL = _DELONG_SQL + f""", fam AS (SELECT *, CASE
  WHEN left(set_1, 1) <> left(set_2, 1) AND substr(set_1, 2) = substr(set_2, 2) THEN 'between pipelines'
  WHEN left(set_1, 1) = left(set_2, 1) THEN 'within ' || left(set_1, 1) END AS family FROM delong),
kept AS (SELECT * FROM fam WHERE family IS NOT NULL), h AS ({_holm_sql('kept', 'family')})
"""


@query("holm_families", _HOLM_FAMILIES_SQL + f"""
SELECT family, set_1, set_2, {rounded('delta', 'p', 'p_holm')}, p_holm < 0.05 AS significant,
  abs(delta) >= 0.005 AS relevant, CASE WHEN abs(delta) < 0.01 THEN 'trivial'
  WHEN abs(delta) < 0.03 THEN 'small' WHEN abs(delta) < 0.05 THEN 'moderate' ELSE 'large' END AS size,
  CASE WHEN p_holm < 0.05 AND abs(delta) >= 0.005 THEN 'yes (relevant)'
       WHEN p_holm < 0.05 THEN 'yes (not relevant)' ELSE 'no' END AS verdict FROM h""")
def holm_families(spark, sf):
    one, two = F.split_part("set_1", F.lit("_"), F.lit(1)), F.split_part("set_2", F.lit("_"), F.lit(1))
    m1, m2 = F.split_part("set_1", F.lit("_"), F.lit(2)), F.split_part("set_2", F.lit("_"), F.lit(2))
    family = F.when((one != two) & (m1 == m2), F.lit("between pipelines")).when(
        one == two, F.concat(F.lit("within "), one))
    tests = _delong(spark, sf).withColumn("family", family).filter(F.col("family").isNotNull())
    rows = compare.with_verdict(compare.holm(tests, ["family"], "p", tie=["set_1", "set_2"]))
    return tidy(rows.select("family", "set_1", "set_2", "delta", "p", "p_holm", "significant",
                            "relevant", "size", "verdict"))


_CORRECT = """, ok AS (SELECT id, pipeline || '_' || model AS s,
  ((score >= threshold)::INTEGER = label) AS good FROM long JOIN youden USING (pipeline, model)),
mc AS (SELECT x.s AS set_1, y.s AS set_2, count(*) FILTER (x.good AND y.good) AS a,
  count(*) FILTER (x.good AND NOT y.good) AS b, count(*) FILTER (NOT x.good AND y.good) AS c,
  count(*) FILTER (NOT x.good AND NOT y.good) AS d
  FROM ok x JOIN ok y USING (id) WHERE x.s < y.s GROUP BY 1, 2)
"""
_MCNEMAR = f""", mct AS (SELECT *, b + c < 25 AS exact,
  CASE WHEN b + c >= 25 THEN (abs(b - c) - 1) ** 2 / (b + c)::DOUBLE END AS chi2 FROM mc),
mcnemar AS (SELECT *, CASE WHEN exact THEN {binomial_p_sql('b', 'b + c')}
                      ELSE {chi2_p_sql('chi2', '1e0')} END AS p FROM mct)
"""


def _mcnemar(spark, sf):
    return compare.mcnemar(wide_scores(spark, sf), _PAIRS, threshold_map(spark, sf))


@query("mcnemar", YOUDEN_SQL + _CORRECT + _MCNEMAR + f"""
SELECT set_1, set_2, a, b, c, d, exact, {rounded('chi2', 'p',
  '(c + d) / (a + b + c + d)::DOUBLE AS error_1', '(b + d) / (a + b + c + d)::DOUBLE AS error_2')}
FROM mcnemar""")
def mcnemar(spark, sf):
    return tidy(_mcnemar(spark, sf))


_REPLICATES = 2000
# The families of pairs: every model between the pipelines, and the best two of each pipeline.
_FAMILIES = f""", aucs AS (
SELECT pipeline, pipeline || '_' || model AS s, {_AUC} AS auc FROM steps GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY auc DESC, s) AS k FROM aucs),
families AS (
SELECT 'between pipelines' AS family, 'a' || substr(s, 2) AS set_1, s AS set_2 FROM aucs
WHERE pipeline = 'b' UNION ALL
SELECT 'best models', min(s), max(s) FROM placed WHERE k <= 2 GROUP BY pipeline)
"""


def _families(spark, sf) -> dict[str, list[tuple[str, str]]]:
    aucs = evaluate.auc(long_scores(spark, sf, ALL_SETS))
    best = ranks.top_k(aucs, ["pipeline"], [F.desc("auc"), F.asc("model")], 2)
    found: dict[str, list[str]] = {}
    for r in best.orderBy("pipeline", "model").collect():  # two rows for each pipeline
        found.setdefault(r["pipeline"], []).append(f"{r['pipeline']}_{r['model']}")
    between = [(f"a_m{k}", f"b_m{k}") for k in range(1, 7)]
    return {"between pipelines": between, "best models": [tuple(v) for v in found.values()]}


def _poisson_sql(u: str) -> str:
    """Poisson(1) count by inverting its distribution function; mass above 18 is below a double."""
    parts, total, mass = [], 0.0, math.exp(-1.0)
    for k in range(18):
        total += mass
        mass /= k + 1
        parts.append(f"({u} >= {total!r}::DOUBLE)::INTEGER")
    return " + ".join(parts)


# A cell of n rows with the same label and scores draws Poisson(n) once, by its smallest id; the
# distribution function of Poisson(n) is listed for each n that occurs.
_BOOT = f""", cells AS (SELECT label, {', '.join(ALL_SETS)}, min(id) AS cell, count(*) AS n
  FROM wide GROUP BY ALL),
mass AS (SELECT n, k, exp(k * ln(n) - n - lgamma(k + 1)) AS m
  FROM (SELECT DISTINCT n FROM cells), LATERAL (SELECT unnest(range(0, 40 + 4 * n)) AS k)),
cdf AS (SELECT n, list(c ORDER BY k) AS cdf FROM (
  SELECT n, k, sum(m) OVER (PARTITION BY n ORDER BY k) AS c FROM mass) GROUP BY n),
uniforms AS (SELECT cells.*, r, {portable_sql('cell', 'r')}::DOUBLE / 2147483647e0 AS u
  FROM cells, range(0, {_REPLICATES + 1}) t(r)),
draws AS (SELECT * EXCLUDE (u), CASE WHEN r = 0 THEN 1 ELSE {_poisson_sql('u')} END AS w
  FROM uniforms WHERE n = 1
  UNION ALL SELECT uniforms.* EXCLUDE (u), CASE WHEN r = 0 THEN n
  ELSE len(list_filter(cdf, lambda c : c <= u)) END FROM uniforms JOIN cdf USING (n) WHERE n > 1),
kept AS (SELECT * FROM draws WHERE w > 0),
wl AS ({" UNION ALL ".join(
    f"SELECT r, '{s}' AS s, {s} AS score, sum(w * label)::DOUBLE AS pos, "
    f"sum(w * (1 - label))::DOUBLE AS neg FROM kept GROUP BY ALL" for s in ALL_SETS)}),
ws AS (SELECT *, sum(pos) OVER (PARTITION BY r, s) AS p, sum(neg) OVER (PARTITION BY r, s) AS n,
  coalesce(sum(neg) OVER (PARTITION BY r, s ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER (PARTITION BY r, s ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (PARTITION BY r, s ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM wl),
m AS (SELECT r, s, sum(pos * (nb + neg / 2)) / (any_value(p) * any_value(n)) AS auc,
  sum(pos / p * tp / (tp + fp)) AS ap,
  2 * coalesce(sum(pos) FILTER (score >= threshold), 0) / (2 * coalesce(sum(pos) FILTER (score >= threshold), 0)
   + coalesce(sum(neg) FILTER (score >= threshold), 0) + coalesce(sum(pos) FILTER (score < threshold), 0)) AS f1
  FROM ws JOIN youden ON s = pipeline || '_' || model GROUP BY 1, 2),
v AS (UNPIVOT m ON auc, ap, f1 INTO NAME metric VALUE value),
diff AS (SELECT set_1, set_2, x.metric, x.r, x.value - y.value AS d
  FROM (SELECT DISTINCT set_1, set_2 FROM families) JOIN v x ON x.s = set_1
  JOIN v y ON y.s = set_2 AND y.r = x.r AND y.metric = x.metric),
boot AS (SELECT set_1, set_2, metric, max(d) FILTER (r = 0) AS observed, avg(d) FILTER (r > 0) AS mean,
  quantile_cont(d, 0.025) FILTER (r > 0) AS low, quantile_cont(d, 0.975) FILTER (r > 0) AS high,
  greatest(1e0 / {_REPLICATES}, least(1e0, 2 * least(avg((d <= 0)::INTEGER) FILTER (r > 0),
    avg((d >= 0)::INTEGER) FILTER (r > 0)))) AS p FROM diff GROUP BY 1, 2, 3)
"""
_BOOT_SQL = ALL_YOUDEN_SQL + _FAMILIES + _BOOT


def _bootstrap(spark, sf, families):
    """All replicates of every pair of the families."""
    pairs = list(dict.fromkeys(p for listed in families.values() for p in listed))
    return compare.bootstrap_paired(
        wide_scores(spark, sf, ALL_SETS), pairs, threshold_map(spark, sf, ALL_SETS), _REPLICATES,
        uniform=portable_draws)


@query("bootstrap_paired", _BOOT_SQL + f"""
SELECT set_1, set_2, metric, {rounded('observed', 'mean', 'low', 'high', 'p')},
       low > 0 OR high < 0 AS excludes_0 FROM boot""")
def bootstrap_paired(spark, sf):
    return tidy(_bootstrap(spark, sf, _families(spark, sf)))


@query("weighted_metrics", SCORES_SQL + f""", w AS (
SELECT pipeline || '_' || model AS s, score, sum((1 + id % 3) * label)::DOUBLE AS pos,
  sum((1 + id % 3) * (1 - label))::DOUBLE AS neg FROM long GROUP BY 1, 2),
st AS (SELECT *, sum(pos) OVER (PARTITION BY s) AS p, sum(neg) OVER (PARTITION BY s) AS n,
  coalesce(sum(neg) OVER (PARTITION BY s ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS nb,
  sum(pos) OVER (PARTITION BY s ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (PARTITION BY s ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM w)
SELECT s AS "set", {rounded('sum(pos * (nb + neg / 2) / p / n) AS auc',
  'sum(pos / p * tp / (tp + fp)) AS ap',
  '2 * sum(pos) FILTER (score >= 0.5) / (2 * sum(pos) FILTER (score >= 0.5)'
  ' + sum(neg) FILTER (score >= 0.5) + sum(pos) FILTER (score < 0.5)) AS f1')} FROM st GROUP BY 1""")
def weighted_metrics(spark, sf):
    wide = wide_scores(spark, sf)
    rows = ranks.stacked(wide, SETS, ["id", "label"], "set", "score").withColumn(
        "weight", 1 + F.pmod("id", F.lit(3)))
    return tidy(compare.weighted_metrics(rows, ["set"], ranks.cut_points(wide, SETS), F.lit(0.5)))


@query("test_agreement", _BOOT_SQL + _COV + _DELONG + f"""
SELECT set_1, set_2, {rounded('delta')}, delong.p < 0.05 AS delong_rejects,
  low > 0 OR high < 0 AS excludes_0, (delong.p < 0.05) = (low > 0 OR high < 0) AS agree
FROM delong JOIN boot USING (set_1, set_2) WHERE metric = 'auc'""")
def test_agreement(spark, sf):
    return tidy(compare.agreement(_delong(spark, sf, ALL_SETS),
                                  _bootstrap(spark, sf, _families(spark, sf))))


def _judged(source: str, by: str, name: str, delta: str | None) -> str:
    """Holm inside the family (and metric), with the verdict."""
    relevant = f"abs({delta}) >= 0.005" if delta else "false"
    hit = "'yes (relevant)'" if delta else "'yes'"
    plain = "'yes (not relevant)'" if delta else "'yes'"
    return f""", f_{name} AS (SELECT * FROM families JOIN {source} USING (set_1, set_2)),
h_{name} AS (SELECT *, CASE WHEN p_holm >= 0.05 THEN 'no' WHEN {relevant} THEN {hit} ELSE {plain} END
  AS verdict FROM ({_holm_sql(f'f_{name}', by)}))"""


_SUMMARY_SQL = (
    _BOOT_SQL + _COV + _DELONG + _CORRECT + _MCNEMAR
    + _judged("delong", "family", "dl", "delta") + _judged("mcnemar", "family", "mc", None)
    + _judged("boot", "family, metric", "bs", "mean"))


@query("three_tests_summary", _SUMMARY_SQL + f"""
SELECT family, set_1, set_2, {rounded('d.delta AS delta', 'd.p_holm AS p_delong')}, d.verdict AS delong,
  {rounded('m.p_holm AS p_mcnemar')}, m.verdict AS mcnemar, {", ".join(
      f"round(max(b.p_holm) FILTER (metric = '{k}'), 6) + 0.0 AS p_bootstrap_{k}, "
      f"max(b.verdict) FILTER (metric = '{k}') AS bootstrap_{k}" for k in ('auc', 'ap', 'f1'))}
FROM h_dl d JOIN h_mc m USING (family, set_1, set_2) JOIN h_bs b USING (family, set_1, set_2)
GROUP BY ALL""")
def three_tests_summary(spark, sf):
    """Every pair of both families under DeLong, McNemar and the bootstrap, Holm inside a family."""
    families = _families(spark, sf)
    pairs = list(dict.fromkeys(p for listed in families.values() for p in listed))
    wide = wide_scores(spark, sf, ALL_SETS)
    return tidy(compare.three_tests(
        _delong(spark, sf, ALL_SETS),
        compare.mcnemar(wide, pairs, threshold_map(spark, sf, ALL_SETS)),
        _bootstrap(spark, sf, families), families))


_HARD_SQL = YOUDEN_SQL + """, t AS (
SELECT max(threshold) FILTER (pipeline = 'a' AND model = 'm1') AS t1,
       max(threshold) FILTER (pipeline = 'b' AND model = 'm1') AS t2 FROM youden),
rk AS (SELECT id, label, a_m1, b_m1, t1, t2,
  (rank() OVER (ORDER BY a_m1) + (count(*) OVER (PARTITION BY a_m1) - 1) / 2e0) / count(*) OVER () AS r1,
  (rank() OVER (ORDER BY b_m1) + (count(*) OVER (PARTITION BY b_m1) - 1) / 2e0) / count(*) OVER () AS r2
  FROM wide, t),
hard AS (SELECT id, CASE WHEN label = 1 THEN 'false negative' ELSE 'false positive' END AS kind,
  a_m1, b_m1, (r1 + r2) / 2 AS mean_rank FROM rk
  WHERE (a_m1 >= t1) = (b_m1 >= t2) AND (a_m1 >= t1)::INTEGER <> label)
"""


def _hard(spark, sf):
    return explain.hard_cases(wide_scores(spark, sf), "a_m1", "b_m1", threshold_map(spark, sf))


@query("hard_cases", _HARD_SQL + f"SELECT id, kind, {rounded('a_m1', 'b_m1', 'mean_rank')} FROM hard")
def hard_cases(spark, sf):
    return tidy(_hard(spark, sf))


@query("clearest_cases", _HARD_SQL + f""", k AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n,
  row_number() OVER (PARTITION BY kind ORDER BY
    CASE WHEN kind = 'false negative' THEN mean_rank ELSE -mean_rank END, id) AS r FROM hard)
SELECT kind, n, id, {rounded('mean_rank')} FROM k WHERE r = 1""")
def clearest_cases(spark, sf):
    return tidy(explain.clearest_cases(_hard(spark, sf)))


@query("case_lookup", _HARD_SQL + """
SELECT base.id, target, segment, nation FROM base WHERE id IN (SELECT id FROM hard)""")
def case_lookup(spark, sf):
    """Base rows of the selected ids."""
    return prepared(spark, sf).join(_hard(spark, sf).select("id"), "id", "left_semi").select(
        "id", "target", "segment", "nation")


_EXPL_SQL = _HARD_SQL + """, ex AS (SELECT id, 'c' || (id % 5 + k) AS condition, k, a_m1, b_m1
  FROM hard, range(0, 4) t(k)),
l AS (SELECT id, condition, round(a_m1 / (k + 1), 6) AS weight_left FROM ex),
r AS (SELECT id, 'c' || (id % 5 + k + id % 3) AS condition, round(b_m1 / (k + 1), 6) AS weight_right FROM ex),
al AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.condition, r.condition) AS condition,
  weight_left, weight_right FROM l FULL JOIN r ON l.id = r.id AND l.condition = r.condition)
"""


def _aligned(spark, sf):
    """Weights by rule for the hard cases, so that SQL can repeat them; ``explanation_chain`` aligns
    those of fitted models."""
    rows = _hard(spark, sf).select("id", "a_m1", "b_m1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    first = F.pmod("id", F.lit(5)) + F.col("k")
    left = rows.select("id", F.concat(F.lit("c"), first).alias("condition"),
                       F.round(F.col("a_m1") / (F.col("k") + 1), 6).alias("weight"))
    right = rows.select("id", F.concat(F.lit("c"), first + F.pmod("id", F.lit(3))).alias("condition"),
                        F.round(F.col("b_m1") / (F.col("k") + 1), 6).alias("weight"))
    return explain.compare_explanations(left, right)


@query("explanation_alignment", _EXPL_SQL + f"""
SELECT id, condition, {rounded('weight_left', 'weight_right')} FROM al""")
def explanation_alignment(spark, sf):
    return tidy(_aligned(spark, sf))


@query("explanation_overlap", _EXPL_SQL + f"""
SELECT id, count(*) FILTER (weight_left IS NOT NULL AND weight_right IS NOT NULL) AS common,
  count(*) AS either, {rounded('count(*) FILTER (weight_left IS NOT NULL AND weight_right IS NOT NULL)'
                               ' / count(*)::DOUBLE AS jaccard')} FROM al GROUP BY 1""")
def explanation_overlap(spark, sf):
    return tidy(explain.explanation_overlap(_aligned(spark, sf)))
