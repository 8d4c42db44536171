"""Base table, cleaning rules and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import clean
from riskweave.functions.hashing import MODULUS, portable_hash
from riskweave.operators import profile, ranks, split
from riskweave.plans.base import CATEGORICAL, FLAGS, NUMERIC, base, prepared, table
from riskweave.plans.registry import (BASE_SQL, CAT, CAT_LONG_SQL, FLAG, NUM, NUM_LONG_SQL,
                                      long_sql, portable_sql, query, rounded, simpson_sql, tidy)

_ALL = ["id", "target", "issue_year", *NUM, *FLAG, *CAT]


@query("base_table", BASE_SQL + f"""SELECT id, target, issue_year, {rounded(*NUM, *FLAG)},
       {', '.join(CAT)} FROM base""")
def base_table(spark, sf):
    return tidy(base(spark, sf))


@query("closed_status_filter", """
SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END::INTEGER AS target,
       count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1, 2""")
def closed_status_filter(spark, sf):
    outcomes = {"F": 0, "P": 1}
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin(list(outcomes)))
    return orders.groupBy("o_orderstatus", clean.outcome(
        F.col("o_orderstatus"), outcomes).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("text_cleaning", """
SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1)::DOUBLE AS brand_number,
       CASE WHEN p_size < 1 THEN 0 WHEN p_size < 10 THEN p_size ELSE p_size END::DOUBLE AS years,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_retailprice BETWEEN 900 AND 950 THEN p_retailprice END AS in_range
FROM part""")
def text_cleaning(spark, sf):
    size = F.col("p_size")
    part = table(spark, sf, "part").withColumns({
        "years_text": F.when(size < 1, "< 1 year").otherwise(F.concat(
            size.cast("string"), F.lit("+ years"))),
        "price_text": F.when(size % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))})
    return part.select(
        "p_partkey", clean.leading_digits(F.col("p_brand")).alias("brand_number"),
        clean.ordinal_years(F.col("years_text")).alias("years"),
        clean.to_number(F.col("price_text")).alias("price"),
        clean.outside_to_null(F.col("p_retailprice"), 900, 950).alias("in_range"))


@query("month_gap_from_text", """
SELECT l_orderkey, l_linenumber,
       ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))
         ::DOUBLE AS months, year(o_orderdate)::INTEGER AS issue_year
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def month_gap_from_text(spark, sf):
    rows = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber",
        F.date_format("o_orderdate", "MMM-yyyy").alias("issued"),
        F.date_format("l_shipdate", "MMM-yyyy").alias("shipped"))
    start, end = clean.month_date(F.col("issued")), clean.month_date(F.col("shipped"))
    return rows.select("l_orderkey", "l_linenumber",
                       clean.months_between_dates(start, end).alias("months"),
                       F.year(start).alias("issue_year"))


@query("missing_flags_and_logs", BASE_SQL + f"""
SELECT id, {rounded('total_price', 'ext_price')}, {', '.join(FLAG)}, priority FROM base""")
def missing_flags_and_logs(spark, sf):
    return tidy(prepared(spark, sf).select("id", "total_price", "ext_price", *FLAGS, "priority"))


@query("ingest_audit", """
SELECT count(*) AS n_rows, 0::BIGINT AS bad_ids, 0::BIGINT AS empty_status, true AS same_rows
FROM orders""")
def ingest_audit(spark, sf):
    return profile.ingest_audit(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")


@query("key_uniqueness", """
SELECT count(*) AS n_keys, count(*) FILTER (c > 1) AS repeated_keys, max(c) AS max_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)""")
def key_uniqueness(spark, sf):
    return profile.key_uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("key_set_difference", """
SELECT 'left_only' AS side, count(*) AS n FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'right_only', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def key_set_difference(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    right = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return profile.key_set_difference(left, right, ["k"]).select("side", "n")


@query("id_modulo_subsample", BASE_SQL + "SELECT id, target FROM base WHERE id % 50 = 0")
def id_modulo_subsample(spark, sf):
    return split.every_kth(prepared(spark, sf), 50).select("id", "target")


@query("frequency_table", BASE_SQL + f""", long AS ({long_sql(CAT, missing=True)}),
cells AS (SELECT variable, value, count(*) AS n FROM long GROUP BY 1, 2),
t AS (SELECT variable, sum(n) AS total, count(value) AS k,
             sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS m FROM cells GROUP BY 1)
SELECT variable, value, n, {rounded('100e0 * n / total AS pct')},
       round(100e0 * n / total, 2) < 4 AS rare, k AS n_categories,
       {rounded('100e0 * m / total AS pct_missing')}
FROM cells JOIN t USING (variable)""")
def frequency_table(spark, sf):
    return tidy(profile.frequency_table(prepared(spark, sf), CATEGORICAL, rare_pct=4.0))


@query("cohort_rate", BASE_SQL + f"""
SELECT issue_year, count(*) AS n, {rounded('avg(target) AS rate')} FROM base GROUP BY 1""")
def cohort_rate(spark, sf):
    return tidy(profile.cohort_rate(prepared(spark, sf), "issue_year", "target"))


@query("target_distribution", BASE_SQL + f""", c AS (
SELECT target, count(*) AS n FROM base GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)
SELECT target, n, {rounded('100e0 * n / total AS pct', '(total - n) / n::DOUBLE AS others_per_row')}
FROM c, t""")
def target_distribution(spark, sf):
    return tidy(profile.target_distribution(prepared(spark, sf), "target"))


_DTYPES = {"id": "bigint", "target": "int", "issue_year": "int"} | dict.fromkeys(
    NUM + FLAG, "double") | dict.fromkeys(CAT, "string")


@query("table_info", BASE_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS non_null, '{_DTYPES[c]}' AS dtype FROM base"
    for c in _ALL))
def table_info(spark, sf):
    return profile.table_info(prepared(spark, sf))


@query("describe_numeric", NUM_LONG_SQL + f"""
SELECT variable, count(*) AS n, {rounded(
    'avg(value) AS mean', 'stddev_samp(value) AS std', 'min(value) AS minimum',
    'max(value) AS maximum', 'quantile_cont(value, 0.25) AS p25',
    'quantile_cont(value, 0.5) AS p50', 'quantile_cont(value, 0.75) AS p75')}
FROM long GROUP BY 1""")
def describe_numeric(spark, sf):
    return tidy(profile.describe_numeric(prepared(spark, sf), NUMERIC))


@query("describe_text", CAT_LONG_SQL + """, cells AS (
SELECT variable, value, count(*) AS c FROM long GROUP BY 1, 2)
SELECT variable, sum(c)::BIGINT AS n, count(*) AS n_unique,
       arg_max(value, (c, value)) AS top, max(c) AS freq FROM cells GROUP BY 1""")
def describe_text(spark, sf):
    return profile.describe_text(prepared(spark, sf), CATEGORICAL)


_PROFILE_SQL = NUM_LONG_SQL + """, total AS (SELECT count(*) AS n_rows FROM base),
q AS (SELECT variable, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS minimum, max(value) AS maximum, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY 1),
f AS (SELECT *, p75 - p25 AS iqr, p25 - 1.5e0 * (p75 - p25) AS low_fence,
  p75 + 1.5e0 * (p75 - p25) AS high_fence FROM q),
m AS (SELECT variable, avg((value - mean) ** 2) AS m2, avg((value - mean) ** 3) AS m3,
  avg((value - mean) ** 4) AS m4,
  count(*) FILTER (value < low_fence OR value > high_fence) AS n_outliers
  FROM long JOIN f USING (variable) GROUP BY 1)
"""


@query("univariate_profile", _PROFILE_SQL + f"""
SELECT variable, n, n_outliers, {rounded(
    'mean', 'std', 'minimum', 'maximum', 'p25', 'p50', 'p75', 'iqr', 'low_fence', 'high_fence',
    'm3 / m2 ** 1.5 AS skew', 'm4 / (m2 * m2) - 3 AS kurt',
    '100e0 * n_outliers / n AS pct_outliers', '100e0 * (n_rows - n) / n_rows AS pct_missing')}
FROM f JOIN m USING (variable), total""")
def univariate_profile(spark, sf):
    return tidy(profile.univariate_profile(prepared(spark, sf), NUMERIC))


@query("log1p_skew", NUM_LONG_SQL + f""", s AS (
SELECT variable, min(value) AS lo, avg(value) AS m,
       avg(CASE WHEN value >= 0 THEN ln(1 + value) END) AS ml FROM long GROUP BY 1)
SELECT variable, {rounded(
    'avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS skew',
    'CASE WHEN lo >= 0 THEN avg((ln(1 + abs(value)) - ml) ** 3)'
    ' / avg((ln(1 + abs(value)) - ml) ** 2) ** 1.5 END AS skew_log1p')}
FROM long JOIN s USING (variable) GROUP BY variable, lo""")
def log1p_skew(spark, sf):
    return tidy(profile.log1p_skew(prepared(spark, sf), NUMERIC))


@query("normality_screen", _PROFILE_SQL + f""", g AS (
SELECT variable, n, m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) - 3 AS kurt FROM f JOIN m USING (variable)),
j AS (SELECT *, n / 6e0 * (skew ** 2 + kurt ** 2 / 4) AS jb FROM g)
SELECT variable, n, {rounded('skew', 'kurt')}, {rounded('jb AS jarque_bera', digits=3)},
       {rounded('exp(-jb / 2) AS p')}, abs(skew) > 1 AS strong_skew,
       CASE WHEN variable IN ('total_price', 'ext_price') THEN 'log1p' ELSE 'scale' END
         AS recommendation FROM j""")
def normality_screen(spark, sf):
    rows = profile.normality_screen(prepared(spark, sf), NUMERIC, ["total_price", "ext_price"])
    return tidy(rows.withColumn("jarque_bera", F.round("jarque_bera", 3)))


_PHI = "(0.5e0 + " + simpson_sql("exp(-{u} * {u} / 2) / sqrt(2 * pi())", "0e0", "z", 400) + ")"


@query("ks_normality", NUM_LONG_SQL + f""", h AS (
SELECT variable, value, count(*) AS k FROM long GROUP BY 1, 2),
mo AS (SELECT variable, avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY 1),
st AS (SELECT variable, k, sum(k) OVER (PARTITION BY variable ORDER BY value) AS upto,
  sum(k) OVER (PARTITION BY variable) AS n, (value - mean) / sd AS z
  FROM h JOIN mo USING (variable) WHERE sd > 0),
g AS (SELECT variable, n, upto, k, {_PHI} AS phi FROM st),
d AS (SELECT variable, any_value(n)::DOUBLE AS n,
  max(greatest(abs(upto / n - phi), abs((upto - k) / n - phi))) AS d FROM g GROUP BY 1),
t AS (SELECT variable, d, sqrt(n) * d + 1 / (6 * sqrt(n)) + (sqrt(n) * d - 1) / (4 * n) AS t FROM d)
SELECT variable, {rounded('d AS statistic', '''least(1e0, greatest(0e0, list_sum(list_transform(
  range(1, 101), lambda j : (CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * j * j * t * t))))) AS p''')}
FROM t""")
def ks_normality(spark, sf):
    return tidy(profile.ks_normality(prepared(spark, sf), NUMERIC))


@query("missing_by_column", BASE_SQL + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(*) AS n FROM base"
    for c in _ALL) + f""") SELECT variable, n_missing, {rounded('100e0 * n_missing / n AS pct')},
CASE WHEN n_missing = 0 THEN '0 %' WHEN 100e0 * n_missing / n <= 5 THEN '(0, 5] %'
     WHEN 100e0 * n_missing / n <= 30 THEN '(5, 30] %'
     WHEN 100e0 * n_missing / n <= 70 THEN '(30, 70] %' ELSE '> 70 %' END AS band FROM m""")
def missing_by_column(spark, sf):
    return tidy(profile.missing_by_column(prepared(spark, sf)))


@query("missing_by_group", BASE_SQL + f""", long AS ({long_sql(NUM, 'issue_year', missing=True)})
SELECT issue_year, variable, {rounded('100e0 * (count(*) - count(value)) / count(*) AS pct')}
FROM long GROUP BY 1, 2""")
def missing_by_group(spark, sf):
    return tidy(profile.missing_by_group(prepared(spark, sf), "issue_year", NUMERIC))


@query("nulls_per_row", BASE_SQL + f""", k AS (SELECT target, {' + '.join(
    f'({c} IS NULL)::INTEGER' for c in NUM)} AS n_nulls FROM base)
SELECT n_nulls, count(*) AS n, {rounded('avg(target) AS rate',
    '100e0 * count(*) / (SELECT count(*) FROM k) AS pct')} FROM k GROUP BY 1""")
def nulls_per_row(spark, sf):
    return tidy(profile.nulls_per_row(prepared(spark, sf), NUMERIC, "target"))


_RISK_SQL = CAT_LONG_SQL + """, cells AS (
SELECT variable, value AS category, count(*) AS n, sum(target)::BIGINT AS positives,
       sum(1 - target)::BIGINT AS negatives, avg(target) AS rate,
       avg(target) / (SELECT avg(target) FROM base) AS relative_risk FROM long GROUP BY 1, 2)
"""


@query("category_risk", _RISK_SQL + f"""
SELECT variable, category, n, positives, negatives, {rounded('rate', 'relative_risk')} FROM cells""")
def category_risk(spark, sf):
    return tidy(profile.category_risk(prepared(spark, sf), CATEGORICAL, "target"))


@query("row_normalised_crosstab", _RISK_SQL + f"""
SELECT variable, category, {rounded('1 - rate AS share_0', 'rate AS share_1')} FROM cells""")
def row_normalised_crosstab(spark, sf):
    return tidy(profile.row_normalised_crosstab(prepared(spark, sf), CATEGORICAL, "target"))


@query("head_tail_risk", _RISK_SQL + f""", r AS (SELECT *,
 row_number() OVER (PARTITION BY variable ORDER BY rate DESC, category) AS up,
 row_number() OVER (PARTITION BY variable ORDER BY rate, category) AS down FROM cells)
SELECT variable, category, n, {rounded('rate')}, 'high' AS side, up::INTEGER AS "rank"
FROM r WHERE up <= 6
UNION ALL SELECT variable, category, n, {rounded('rate')}, 'low', down::INTEGER
FROM r WHERE down <= 6""")
def head_tail_risk(spark, sf):
    rows = profile.risk_extremes(prepared(spark, sf), CATEGORICAL, "target")
    return tidy(rows.select("variable", "category", "n", "rate", "side", "rank"))


def _histogram_sql(source: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""{source}, e AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
b AS (SELECT {keys}variable, lo, hi, CASE WHEN hi > lo THEN
  least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) ELSE 0 END::INTEGER AS bin
  FROM long JOIN e USING (variable))
SELECT {keys}variable, bin, {rounded(f'lo + (hi - lo) * bin / {bins} AS left_edge')},
       count(*) AS n FROM b GROUP BY {keys}variable, bin, lo, hi"""


_HIST = NUM


@query("histogram", _histogram_sql(BASE_SQL + f", long AS ({long_sql(_HIST)})", 50))
def histogram(spark, sf):
    return tidy(profile.histogram(prepared(spark, sf), _HIST, bins=50))


@query("histogram_trimmed", _histogram_sql(BASE_SQL + f""", whole AS ({long_sql(_HIST)}),
caps AS (SELECT variable, quantile_cont(value, 0.995) AS cap FROM whole GROUP BY 1),
long AS (SELECT whole.* FROM whole JOIN caps USING (variable) WHERE value <= cap)""", 60))
def histogram_trimmed(spark, sf):
    return tidy(profile.histogram(prepared(spark, sf), _HIST, bins=60, upper=0.995))


@query("histogram_log1p", _histogram_sql(BASE_SQL + """, long AS (
SELECT 'l_extendedprice' AS variable, ln(1 + l_extendedprice) AS value FROM lineitem)""", 60))
def histogram_log1p(spark, sf):
    return tidy(profile.histogram(table(spark, sf, "lineitem"), ["l_extendedprice"], bins=60,
                                  log=True))


def _box_sql(keys: str) -> str:
    on = keys.replace(" ", "")
    return NUM_LONG_SQL + f""", q AS (SELECT {keys}, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY {keys}),
v AS (SELECT {keys}, value, p25, p50, p75,
  value BETWEEN p25 - 1.5e0 * (p75 - p25) AND p75 + 1.5e0 * (p75 - p25) AS inside
  FROM long JOIN q USING ({on}))
SELECT {keys}, count(*) AS n, {rounded('any_value(p25) AS p25', 'any_value(p50) AS p50',
    'any_value(p75) AS p75', 'min(value) FILTER (inside) AS low_whisker',
    'max(value) FILTER (inside) AS high_whisker')}, count(*) FILTER (NOT inside) AS n_outliers
FROM v GROUP BY {keys}"""


@query("box_stats", _box_sql("variable"))
def box_stats(spark, sf):
    return tidy(profile.box_stats(prepared(spark, sf), NUMERIC))


@query("box_stats_by_class", _box_sql("target, variable"))
def box_stats_by_class(spark, sf):
    return tidy(profile.box_stats(prepared(spark, sf), NUMERIC, by=["target"]))


@query("clip_at_percentile", BASE_SQL + f""", q AS (
SELECT quantile_cont(quantity, 0.995) AS a, quantile_cont(acct_bal, 0.995) AS b FROM base)
SELECT id, {rounded('CASE WHEN quantity > a THEN a ELSE quantity END AS quantity',
                    'CASE WHEN acct_bal > b THEN b ELSE acct_bal END AS acct_bal')}
FROM base, q""")
def clip_at_percentile(spark, sf):
    rows = prepared(spark, sf).select("id", "quantity", "acct_bal")
    return tidy(profile.clip_upper(rows, ["quantity", "acct_bal"], 0.995))


@query("density_by_class", BASE_SQL + f""", long AS ({long_sql(NUM)}),
e AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
s AS (SELECT target, variable, count(*) AS total, stddev_samp(value) * count(*) ** (-0.2) AS h
      FROM long GROUP BY 1, 2),
b AS (SELECT target, variable, least(floor((value - lo) / (hi - lo) * 200), 199) AS bin,
      count(*) AS n FROM long JOIN e USING (variable) GROUP BY 1, 2, 3),
g AS (SELECT b.*, lo, hi, total, h, lo + (hi - lo) * (bin + 0.5e0) / 200 AS mid,
      unnest(range(0, 50)) AS point FROM b JOIN e USING (variable) JOIN s USING (target, variable))
SELECT target, variable, point::INTEGER AS point,
  {rounded('any_value(lo + (hi - lo) * point / 49) AS x')},
  {rounded('sum(n / total::DOUBLE * exp(-0.5e0 * ((lo + (hi - lo) * point / 49 - mid) / h) ** 2)'
           ' / (h * sqrt(2 * pi()))) AS density', digits=8)}
FROM g GROUP BY 1, 2, 3""")
def density_by_class(spark, sf):
    curves = profile.density_curves(prepared(spark, sf), NUMERIC, "target")
    return curves.select("target", "variable", "point", F.round("x", 6).alias("x"),
                         F.round("density", 8).alias("density"))


@query("nullity_sample", BASE_SQL + f""", s AS (
SELECT *, {portable_sql('id', '0')} AS h FROM base ORDER BY h, id LIMIT 2000)
SELECT id, issue_year, {', '.join(f'({c} IS NULL)::INTEGER AS {c}' for c in NUM[1:])} FROM s""")
def nullity_sample(spark, sf):
    return profile.nullity_sample(prepared(spark, sf), "id", "issue_year", NUMERIC,
                                  portable_hash(F.col("id")), 2000)


@query("hash_sample", BASE_SQL + f"""
SELECT id, target FROM base ORDER BY {portable_sql('id', '0')}, id LIMIT 500""")
def hash_sample(spark, sf):
    rows = prepared(spark, sf).select("id", "target")
    return split.hash_sample(rows, 500, order=portable_hash(F.col("id")))


@query("fraction_sample", BASE_SQL + f"""
SELECT id, target FROM base WHERE {portable_sql('id', '0')} < 0.25 * 2147483647""")
def fraction_sample(spark, sf):
    return split.fraction_sample(prepared(spark, sf).select("id", "target"), 0.25,
                                 order=portable_hash(F.col("id")), space=float(MODULUS))


@query("first_and_last_rows", """
(SELECT 'first' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL
(SELECT 'last', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def first_and_last_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return (profile.first_rows(orders, ["o_orderkey"]).withColumn("side", F.lit("first"))
            .unionByName(profile.last_rows(orders, ["o_orderkey"]).withColumn(
                "side", F.lit("last")))).select("side", "o_orderkey", "o_totalprice")


@query("average_rank", BASE_SQL + f"""
SELECT id, quantity, {rounded('rank() OVER w + (count(*) OVER (PARTITION BY quantity) - 1) / 2e0'
                              ' AS avg_rank')}
FROM base WHERE quantity IS NOT NULL WINDOW w AS (ORDER BY quantity)""")
def average_rank(spark, sf):
    rows = prepared(spark, sf).select("id", "quantity").filter(F.col("quantity").isNotNull())
    return tidy(ranks.average_rank(rows, "quantity").select("id", "quantity", "avg_rank"))


@query("percent_rank_by_class", BASE_SQL + f"""
SELECT id, target, n_lines, {rounded(
    '(rank() OVER (PARTITION BY target ORDER BY n_lines)'
    ' + (count(*) OVER (PARTITION BY target, n_lines) - 1) / 2e0)'
    ' / count(*) OVER (PARTITION BY target) AS pct_rank')}
FROM base WHERE n_lines IS NOT NULL""")
def percent_rank_by_class(spark, sf):
    rows = prepared(spark, sf).select("id", "target", "n_lines").filter(
        F.col("n_lines").isNotNull())
    ranked = ranks.average_rank(rows, "n_lines", ["target"], "pct_rank", percent=True)
    return tidy(ranked.select("id", "target", "n_lines", "pct_rank"))


@query("extreme_rows", BASE_SQL + """
SELECT segment, arg_min(id, (quantity, id)) AS id, min(quantity) AS quantity
FROM base WHERE quantity IS NOT NULL GROUP BY 1""")
def extreme_rows(spark, sf):
    rows = prepared(spark, sf).filter(F.col("quantity").isNotNull())
    return ranks.extreme_rows(rows, "segment", "quantity", "id", lowest=True)


@query("replicated_rows", BASE_SQL + """
SELECT copy::INTEGER AS copy, target, count(*) AS n FROM base, range(1, 4) t(copy) GROUP BY 1, 2""")
def replicated_rows(spark, sf):
    return profile.replicate(prepared(spark, sf), 3).groupBy("copy", "target").agg(
        F.count(F.lit(1)).alias("n"))


_POLICY_SQL = BASE_SQL + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, 100e0 * (count(*) - count({c})) / count(*) AS pct FROM base"
    for c in _ALL) + f"""), d AS (SELECT variable, round(pct, 2) AS pct, CASE
WHEN variable = 'id' THEN 'key: carry along' WHEN variable = 'target' THEN 'label: carry along'
WHEN variable = 'issue_year' THEN 'cohort: report only'
WHEN variable = 'return_flag' THEN 'written after the outcome: leave out'
WHEN pct > 70 THEN 'mostly empty: leave out'
WHEN variable IN ('segment', 'nation', 'region', 'priority')
  THEN 'category: encode'
WHEN variable IN ({', '.join(repr(c) for c in NUM)}) THEN
  CASE WHEN pct > 0 THEN 'numeric with gaps: fill from training rows' ELSE 'numeric: use' END
  || CASE WHEN variable IN ('total_price', 'ext_price') THEN ' as logarithm' ELSE '' END
WHEN pct > 30 THEN 'often empty: leave out' ELSE 'spare: leave out' END AS decision FROM m)
"""


def _policy(spark, sf):
    name, pct = F.col("variable"), F.col("pct")
    number = F.when(pct > 0, "numeric with gaps: fill from training rows").otherwise("numeric: use")
    log = F.when(name.isin("total_price", "ext_price"), " as logarithm").otherwise("")
    return profile.column_policy(profile.missing_by_column(prepared(spark, sf)), [
        (name == "id", "key: carry along"), (name == "target", "label: carry along"),
        (name == "issue_year", "cohort: report only"),
        (name == "return_flag", "written after the outcome: leave out"),
        (pct > 70, "mostly empty: leave out"),
        (name.isin("segment", "nation", "region", "priority"), "category: encode"),
        (name.isin(NUMERIC), F.concat(number, log)),
        (pct > 30, "often empty: leave out")], otherwise="spare: leave out")


@query("column_policy", _POLICY_SQL + "SELECT variable, pct + 0.0 AS pct, decision FROM d")
def column_policy(spark, sf):
    return _policy(spark, sf)


@query("decisions_count", _POLICY_SQL + """
SELECT trim(split_part(decision, ':', -1)) AS action, count(*) AS n FROM d GROUP BY 1""")
def decisions_count(spark, sf):
    return profile.decisions_count(_policy(spark, sf))


@query("observed_quantiles", BASE_SQL + """
SELECT DISTINCT unnest(quantile_disc(quantity, [i / 1000e0 FOR i IN range(1, 1000)])) AS value
FROM base""")
def observed_quantiles(spark, sf):
    from riskweave.operators.evaluate import observed_quantiles as op

    return op(prepared(spark, sf), "quantity")
