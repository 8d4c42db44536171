"""Association tests and matrices."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskweave.operators import assoc, mcar
from riskweave.plans.base import CATEGORICAL, FLAGS, NUMERIC, prepared
from riskweave.plans.registry import (BASE_SQL, CAT, NUM, NUM_LONG_SQL, chi2_p_sql, normal_p_sql,
                                      query, rounded, t_p_sql, tidy)

_MISSING = ["ext_price", "n_lines", "quantity", "discount", "tax", "ship_gap", "priority_rank",
            "acct_bal"]


@query("welch_t", NUM_LONG_SQL + f""", g AS (SELECT variable,
 count(*) FILTER (target = 0)::DOUBLE AS n0, count(*) FILTER (target = 1)::DOUBLE AS n1,
 avg(value) FILTER (target = 0) AS mean0, avg(value) FILTER (target = 1) AS mean1,
 var_samp(value) FILTER (target = 0) AS v0, var_samp(value) FILTER (target = 1) AS v1,
 quantile_cont(value, 0.5) FILTER (target = 0) AS median0,
 quantile_cont(value, 0.5) FILTER (target = 1) AS median1 FROM long GROUP BY 1),
t AS (SELECT *, (mean1 - mean0) / sqrt(v0 / n0 + v1 / n1) AS t,
 (v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)) AS df FROM g)
SELECT variable, {rounded('mean0', 'mean1', 'mean1 - mean0 AS difference', 't', 'median0',
                          'median1')}, {rounded('df', digits=3)}, {rounded(t_p_sql('t', 'df') + ' AS p')}
FROM t""")
def welch_t(spark, sf):
    rows = assoc.welch_t(prepared(spark, sf), NUMERIC, "target")
    return tidy(rows.withColumn("df", F.round("df", 3)))


@query("mann_whitney_auc", NUM_LONG_SQL + f""", r AS (SELECT variable, target, value,
 rank() OVER (PARTITION BY variable ORDER BY value)
   + (count(*) OVER (PARTITION BY variable, value) - 1) / 2e0 AS rk FROM long),
n AS (SELECT variable, count(*) FILTER (target = 0)::DOUBLE AS n0,
      count(*) FILTER (target = 1)::DOUBLE AS n1, sum(rk) FILTER (target = 1) AS s1 FROM r GROUP BY 1),
ties AS (SELECT variable, sum(c ** 3 - c) AS ties FROM (
  SELECT variable, value, count(*)::DOUBLE AS c FROM long GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT variable, n0, n1, ties, s1 - n1 * (n1 + 1) / 2 AS u FROM n JOIN ties USING (variable)),
z AS (SELECT *, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5e0) / sqrt(n0 * n1 / 12
  * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM u)
SELECT variable, {rounded('u', digits=1)}, {rounded('u / (n0 * n1) AS auc', 'z')},
  {rounded(f"least(1e0, CASE WHEN z > 0 THEN {normal_p_sql('z')} ELSE 1e0 END) AS p")} FROM z""")
def mann_whitney_auc(spark, sf):
    rows = assoc.mann_whitney(prepared(spark, sf), NUMERIC, "target")
    return tidy(rows.withColumn("u", F.round("u", 1)))


@query("point_biserial", NUM_LONG_SQL + f""", r AS (
SELECT variable, count(*) AS n, corr(value, target) AS r FROM long GROUP BY 1),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM r)
SELECT variable, n, {rounded('r', 't', t_p_sql('t', 'df') + ' AS p')} FROM t""")
def point_biserial(spark, sf):
    return tidy(assoc.point_biserial(prepared(spark, sf), NUMERIC, "target"))


def _cramer_sql(pairs: list[tuple[str, str]]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS var_1, '{b}' AS var_2, {a}::VARCHAR AS a, {b}::VARCHAR AS b,"
        f" count(*)::DOUBLE AS o FROM base WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        f" GROUP BY ALL" for a, b in pairs)
    return BASE_SQL + f""", cells AS ({cells}),
ra AS (SELECT var_1, var_2, a, sum(o) AS ro FROM cells GROUP BY 1, 2, 3),
cb AS (SELECT var_1, var_2, b, sum(o) AS co FROM cells GROUP BY 1, 2, 3),
tot AS (SELECT var_1, var_2, sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k
        FROM cells GROUP BY 1, 2),
grid AS (SELECT var_1, var_2, n, r, k, ro * co / n AS e, coalesce(o, 0) AS o
  FROM ra JOIN cb USING (var_1, var_2) JOIN tot USING (var_1, var_2)
  LEFT JOIN cells USING (var_1, var_2, a, b)),
x AS (SELECT var_1, var_2, n, r, k, sum((o - e) ** 2 / e) AS chi2 FROM grid GROUP BY ALL),
v AS (SELECT *, ((r - 1) * (k - 1))::BIGINT AS dof,
  sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / greatest(least(
    k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1), 1e-12)) AS v FROM x)
SELECT var_1, var_2, n::BIGINT AS n, dof, {rounded('chi2', 'v', chi2_p_sql('chi2', 'dof::DOUBLE') + ' AS p')}
FROM v"""


_TARGET_PAIRS = [(c, "target") for c in CAT]


@query("cramers_v", _cramer_sql(_TARGET_PAIRS))
def cramers_v(spark, sf):
    return tidy(assoc.cramers_v(prepared(spark, sf), _TARGET_PAIRS))


@query("cramers_v_matrix", _cramer_sql(list(combinations(CAT, 2))))
def cramers_v_matrix(spark, sf):
    return tidy(assoc.cramers_v_matrix(prepared(spark, sf), CATEGORICAL))


def _yates_sql() -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*)::DOUBLE AS n, (count(*) - count({c}))::DOUBLE AS m,"
        f" sum(target * ({c} IS NULL)::INTEGER)::DOUBLE AS pm, sum(target)::DOUBLE AS p FROM base"
        for c in _MISSING)
    parts = " + ".join(
        f"(abs({o} - {r} * {c} / n) - least(0.5e0, abs({o} - {r} * {c} / n))) ** 2 / ({r} * {c} / n)"
        for o, r, c in (("pm", "m", "p"), ("(m - pm)", "m", "(n - p)"),
                        ("(p - pm)", "(n - m)", "p"), ("(n - m - p + pm)", "(n - m)", "(n - p)")))
    return BASE_SQL + f""", c AS ({counts}), x AS (SELECT *, {parts} AS chi2 FROM c WHERE m > 0 AND m < n)
SELECT variable, {rounded('100 * m / n AS pct_missing', '100 * (p - pm) / (n - m) AS rate_present',
    '100 * pm / m AS rate_missing', 'chi2',
    '100 * pm / m - 100 * (p - pm) / (n - m) AS difference_pp',
    chi2_p_sql('chi2', '1e0') + ' AS p')} FROM x"""


@query("missing_vs_target", _yates_sql())
def missing_vs_target(spark, sf):
    return tidy(assoc.missing_vs_target(prepared(spark, sf), _MISSING, "target"))


_PEARSON_SQL = BASE_SQL + ", r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr({a}, {b}) AS r FROM base"
    for a, b in combinations(NUM, 2)) + ")"


@query("pearson_pairs", _PEARSON_SQL + f" SELECT var_1, var_2, {rounded('r')} FROM r")
def pearson_pairs(spark, sf):
    return tidy(assoc.pearson_pairs(prepared(spark, sf), NUMERIC))


@query("strong_pearson_pairs",
       _PEARSON_SQL + f" SELECT var_1, var_2, {rounded('r')} FROM r WHERE abs(r) > 0.7")
def strong_pearson_pairs(spark, sf):
    return tidy(assoc.pearson_pairs(prepared(spark, sf), NUMERIC, above=0.7))


@query("nullity_correlation", BASE_SQL + ", r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr(({a} IS NULL)::INTEGER, ({b} IS NULL)::INTEGER)"
    f" AS r FROM base" for a, b in combinations(NUM, 2))
    + f") SELECT var_1, var_2, {rounded('r')} FROM r WHERE r IS NOT NULL AND NOT isnan(r)")
def nullity_correlation(spark, sf):
    return tidy(assoc.nullity_correlation(prepared(spark, sf), NUMERIC))


_ETA = [(c, x) for c in CAT for x in NUM]


@query("eta_squared", BASE_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{x}' AS variable, {c} AS level, {x} AS x FROM base"
    f" WHERE {c} IS NOT NULL AND {x} IS NOT NULL" for c, x in _ETA) + f"""),
g AS (SELECT category, variable, avg(x) AS m FROM long GROUP BY 1, 2),
l AS (SELECT category, variable, level, count(*) AS n, avg(x) AS lm FROM long GROUP BY 1, 2, 3),
b AS (SELECT category, variable, sum(n * (lm - m) ** 2) AS bss FROM l JOIN g USING (category, variable)
      GROUP BY 1, 2),
t AS (SELECT category, variable, sum((x - m) ** 2) AS tss FROM long JOIN g USING (category, variable)
      GROUP BY 1, 2)
SELECT category, variable, {rounded('bss / tss AS eta2')} FROM b JOIN t USING (category, variable)""")
def eta_squared(spark, sf):
    return tidy(assoc.eta_squared(prepared(spark, sf), _ETA))


_LITTLE = ["quantity", "ship_gap", "priority_rank", "acct_bal"]


@query("mcar_patterns", BASE_SQL + f""", m AS (SELECT {', '.join(
    f'avg({c}) AS m_{c}' for c in _LITTLE)} FROM base)
SELECT {' || '.join(f'({c} IS NOT NULL)::INTEGER::VARCHAR' for c in _LITTLE)} AS pattern,
  count(*) AS n, {rounded(*[f'sum({c} - m_{c}) AS s_{c}' for c in _LITTLE],
    *[f'sum(({a} - m_{a}) * ({b} - m_{b})) AS s_{a}__{b}'
      for i, a in enumerate(_LITTLE) for b in _LITTLE[i:]], digits=1)}
FROM base, m GROUP BY 1""")
def mcar_patterns(spark, sf):
    return tidy(mcar.missing_patterns(prepared(spark, sf), _LITTLE), 1)


@query("little_mcar")
def little_mcar(spark, sf):
    b = prepared(spark, sf).withColumn("target", F.col("target").cast("double"))
    return mcar.little_mcar(b, [*_MISSING, "target"])


@query("little_mcar_sample")
def little_mcar_sample(spark, sf):
    """The same test on a fixed-size random sample."""
    from riskweave.operators.split import hash_sample

    b = prepared(spark, sf).withColumn("target", F.col("target").cast("double"))
    return mcar.little_mcar(hash_sample(b, 5000), [*_MISSING, "target"])


@query("flag_association", _cramer_sql([(f, "target") for f in FLAGS]))
def flag_association(spark, sf):
    return tidy(assoc.cramers_v(prepared(spark, sf), [(f, "target") for f in FLAGS]))
