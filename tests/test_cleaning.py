"""Text files, cleaning rules, profiles with edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.functions import clean
from riskweave.operators import assoc, equiv, profile
from riskweave.session import scratch_path
from riskweave.sources import text
from riskweave.spec import LOANS, LOANS_LEAKAGE, read_spec, write_spec


def one(spark, value, rule, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(rule(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize("rule, value, expected", [
    (clean.to_number, "12.5", 12.5), (clean.to_number, "abc", None), (clean.to_number, "NaN", None),
    (clean.leading_digits, " 36 months", 36.0), (clean.leading_digits, "none", None),
    (clean.ordinal_years, "< 1 year", 0.0), (clean.ordinal_years, "10+ years", 10.0),
    (clean.ordinal_years, "3 years", 3.0), (clean.ordinal_years, None, None),
    (clean.month_date, "Mar-2016", dt.date(2016, 3, 1)), (clean.month_date, "soon", None),
])
def test_text_rules(spark, rule, value, expected):
    assert one(spark, value, rule) == expected


def test_band_edges(spark):
    def rule(c):
        return clean.band(c, [0, 5, 30, 70], ["0", "5", "30", "70", ">70"])

    got = [one(spark, float(v), rule, "double") for v in (0, 0.1, 5, 5.1, 30, 70, 70.1)]
    assert got == ["0", "5", "5", "30", "30", "70", ">70"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert clean.nan_to_null(df).agg(F.count("a")).first()[0] == 1


LOAN_ROWS = [
    {"id": "1", "loan_status": "Fully Paid", "term": " 36 months", "emp_length": "< 1 year",
     "issue_d": "Dec-2015", "earliest_cr_line": "Jan-2010", "dti": "12.5", "annual_inc": "0",
     "home_ownership": "ANY", "desc": 'two\nlines, "quoted"', "int_rate": "5.3"},
    {"id": "2", "loan_status": "Charged Off", "term": " 60 months", "emp_length": "10+ years",
     "issue_d": "Jan-2016", "earliest_cr_line": "bad", "dti": "999", "annual_inc": "100",
     "home_ownership": "RENT", "desc": "", "int_rate": "oops"},
    {"id": "3", "loan_status": "Current", "term": " 36 months", "emp_length": None,
     "issue_d": "Jan-2016", "earliest_cr_line": "Jan-2015", "dti": "1", "annual_inc": "1",
     "home_ownership": "OWN", "desc": "", "int_rate": "1"},
    {"id": "Total amount funded", "loan_status": None},
]


def loan_file(spark):
    wanted = {LOANS.id, LOANS.status, "issue_d", "earliest_cr_line", "desc",
              "mths_since_last_delinq", *LOANS.numeric, *LOANS.categorical}
    columns = sorted(wanted - set(LOANS.month_gaps))
    rows = [tuple(r.get(c) for c in columns) for r in LOAN_ROWS]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    path = scratch_path(spark, "loans")
    text.write_text_csv(df, path)
    return path, columns


def test_loan_file_to_base_table(spark):
    path, columns = loan_file(spark)
    raw = text.read_text_csv(spark, path)
    assert raw.columns == columns and set(dict(raw.dtypes).values()) == {"string"}
    assert raw.filter("id = '1'").first()["desc"] == 'two\nlines, "quoted"'
    rows = {r["id"]: r for r in text.read_base(spark, path, LOANS).collect()}
    assert set(rows) == {1, 2}
    first, second = rows[1], rows[2]
    assert (first["target"], second["target"]) == (0, 1)
    assert (first["term"], first["emp_length"], second["emp_length"]) == (36.0, 0.0, 10.0)
    assert (first["credit_age_months"], second["credit_age_months"]) == (71.0, None)
    assert (first["dti"], second["dti"], second["int_rate"]) == (12.5, None, None)
    assert first["annual_inc"] == 0.0 and first["home_ownership"] == "OTHER"
    assert (first["had_delinquency"], first["balance_missing"]) == (0.0, 1.0)
    assert first["issue_year"] == 2015


def test_ingest_audit_finds_the_footer(spark):
    path, _ = loan_file(spark)
    row = profile.ingest_audit(text.read_text_csv(spark, path), "id", "loan_status").first()
    assert (row["bad_ids"], row["empty_status"], row["same_rows"]) == (1, 1, True)


def test_spec_round_trip(spark):
    path = scratch_path(spark, "spec")
    write_spec(spark, LOANS, path)
    assert read_spec(spark, path) == LOANS
    assert len(LOANS.numeric) == 20 and len(LOANS.flags) == 4 and len(LOANS_LEAKAGE) == 40


def test_constant_and_missing_columns_do_not_break_profiles(spark):
    df = spark.createDataFrame(
        [(i, i % 2, 3.0, None, float(i)) for i in range(20)],
        "id long, target int, c double, m double, x double")
    rows = {r["variable"]: r for r in profile.univariate_profile(df, ["c", "m", "x"]).collect()}
    assert rows["c"]["iqr"] == 0 and rows["c"]["n_outliers"] == 0
    assert rows["m"]["n"] == 0 and rows["m"]["pct_missing"] == 100
    assert rows["x"]["p50"] == 9.5
    assert {r["variable"]: r["r"] for r in assoc.point_biserial(
        df, ["c", "x"], "target").collect()}["c"] is None
    pairs = {(r["var_1"], r["var_2"]): r["r"] for r in assoc.pearson_pairs(df, ["c", "x"]).collect()}
    assert pairs[("c", "x")] is None
    one = {r["variable"]: r for r in profile.histogram(df, ["c"], bins=10).collect()}
    assert one["c"]["n"] == 20


def test_cramers_v_counts_empty_cells(spark):
    rows = [("a", "x")] * 30 + [("b", "y")] * 20 + [("b", "x")] * 10
    df = spark.createDataFrame(rows, "p string, q string")
    row = assoc.cramers_v(df, [("p", "q")]).first()
    n, table = 60, {("a", "x"): 30, ("a", "y"): 0, ("b", "x"): 10, ("b", "y"): 20}
    r, c = {"a": 30, "b": 30}, {"x": 40, "y": 20}
    chi2 = sum((o - r[a] * c[b] / n) ** 2 / (r[a] * c[b] / n) for (a, b), o in table.items())
    assert row["chi2"] == pytest.approx(chi2) and row["dof"] == 1


def test_category_equivalence_sees_a_changed_row(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    b = spark.createDataFrame([("x",), ("x",), (None,)], "c string")
    row = equiv.category_equivalence(a, b, ["c"]).first()
    assert (row["categories"], row["different"]) == (3, 2)


def test_density_integrates_to_one(spark):
    df = spark.range(5000).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.randn(3).alias("x"))
    rows = profile.density_curves(df, ["x"], "y", points=200).filter("y = 0").orderBy("x").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1, abs=0.02)


def test_policy_order(spark):
    prof = spark.createDataFrame([("id", 0.0), ("late", 90.0), ("gone", 80.0), ("num", 5.0),
                                  ("cat", 0.0), ("half", 40.0), ("rest", 0.0)],
                                 "variable string, pct double")
    name, pct = F.col("variable"), F.col("pct")
    rows = profile.column_policy(prof, [
        (name == "id", "key: keep"), (name == "late", "late: drop"), (pct > 70, "empty: drop"),
        (name == "num", F.concat(F.lit("number: "), F.round(pct, 0).cast("int"))),
        (pct > 30, "gaps: drop")], "rest: drop")
    got = {r["variable"]: r["decision"] for r in rows.collect()}
    assert got == {"id": "key: keep", "late": "late: drop", "gone": "empty: drop",
                   "num": "number: 5", "cat": "rest: drop", "half": "gaps: drop",
                   "rest": "rest: drop"}
    counts = {r["action"]: r["n"] for r in profile.decisions_count(rows).collect()}
    assert counts["drop"] == 5
