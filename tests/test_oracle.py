"""Every query with an SQL counterpart, compared with DuckDB value by value."""

import pytest

from riskweave.plans import QUERIES, SQL
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert difference(spark, duck, SF, QUERIES[name], SQL[name]) is None


def sizes(rows, *keys):
    out = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        out[key] = out.get(key, 0) + 1
    return out


#: What must hold for queries that SQL cannot express.
HOLDS = {
    "little_mcar": lambda rows: rows[0]["converged"] and rows[0]["dof"] > 0 <= rows[0]["p"] <= 1,
    "tuned_naivebayes": lambda rows: {r["rule"] for r in rows} == {"youden", "default"}
    and all(r["fits"] == 4 and 0.3 < r["auc"] < 1 and r["threshold"] == 0.5 for r in rows
            if r["rule"] == "default"),
    "lime_batch": lambda rows: set(sizes(rows, "id").values()) == {10} and len(rows) == 40
    and all(r["r2"] <= 1 for r in rows),
    "explanation_chain": lambda rows: {r["kind"] for r in rows} <= {
        "false negative", "false positive"} and all(
        (r["weight_left"], r["weight_right"]) != (None, None) for r in rows)
    and all(n == r["either"] and r["common"] == 20 - n for r in rows
            for n in [sizes(rows, "id")[r["id"],]]),
    "cv_inside_pipeline": lambda rows: len(rows) == 3 and all(0.3 < r["mean_auc"] < 1 for r in rows),
    "pruning_variants": lambda rows: len(rows) > 1,
    "partition_balance": lambda rows: len(rows) > 0,
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_query_without_sql(spark, name):
    assert HOLDS[name](QUERIES[name](spark, SF).collect())


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns[:2] == ["variable", "category"] and df.count() > 0
