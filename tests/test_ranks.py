"""Ranking helpers against numpy on small tables with hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import ranks, split
from riskweave.session import materialise


def hot_values(seed=0, n=3000):
    """A third of the rows share one value, a few are missing."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 1 / 3, 5.0, np.round(rng.normal(0, 4, n), 2))
    return [(i, i % 2, None if i % 97 == 0 else float(v)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(hot_values(), "id long, label int, x double").repartition(7).cache()


def values(label=None):
    return np.array([v for _, y, v in hot_values() if v is not None and label in (None, y)])


@pytest.mark.parametrize("buckets", [1, 5, 400])
def test_quantiles_do_not_depend_on_cuts(table, buckets):
    probs = [0.0, 0.001, 0.25, 0.5, 0.731, 0.995, 1.0]
    cuts = ranks.cut_points(table, ["x"], buckets)
    got = ranks.exact_quantiles(table, ["x"], probs, cuts=cuts).first()["q"]
    assert got == pytest.approx(list(np.quantile(values(), probs)), abs=1e-12)


def test_observed_quantiles_match_numpy(table):
    probs = [i / 100 for i in range(1, 100)]
    got = ranks.exact_quantiles(table, ["x"], probs, method="observed").first()["q"]
    assert got == list(np.quantile(values(), probs, method="inverted_cdf"))


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_by_group(table, small):
    rows = ranks.exact_quantiles(table, ["x"], [0.5], by=["label"], small_groups=small).collect()
    assert {r["label"]: r["q"][0] for r in rows} == {
        y: pytest.approx(np.median(values(y))) for y in (0, 1)}


def test_quantiles_of_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    rows = {r["variable"]: r["q"] for r in ranks.exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert rows == {"a": [2.0]}


def test_prefix_sums_equal_plain_running_sums(table):
    hist = ranks.value_histogram(table.dropna(), ["label"], "x", {"n": F.count(F.lit(1))})
    rows = ranks.prefix_sums(hist, ["label"], "x", ["n"], ranks.cut_points(table, ["x"])).collect()
    for y in (0, 1):
        v = values(y)
        for r in (r for r in rows if r["label"] == y):
            assert r["n_before"] == (v < r["x"]).sum() and r["n_total"] == len(v)


def test_average_rank_with_ties(table):
    rows = ranks.average_rank(table.dropna(), "x", percent=True).collect()
    v = values()
    for r in rows[::50]:
        expected = ((v < r["x"]).sum() + ((v == r["x"]).sum() + 1) / 2) / len(v)
        assert r["avg_rank"] == pytest.approx(expected)


def test_plan_has_no_global_window(table):
    hist = ranks.value_histogram(table.dropna(), ["label"], "x")
    plan = ranks.prefix_sums(hist, ["label"], "x", ["n"], ranks.cut_points(
        table, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_histogram_is_shuffled_once(table):
    long = ranks.unpivot(materialise(table, "hot"), ["x"], ["label"])
    hist = ranks.value_histogram(long, ["label"], "value")
    df = ranks.prefix_sums(hist, ["label"], "value", ["n"], [0.0, 2.0])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_head_and_tail(spark):
    df = spark.createDataFrame([("g", i) for i in range(20)], "g string, v int")
    rows = ranks.head_and_tail(df, ["g"], [F.asc("v")], [F.desc("v")], 3).collect()
    assert sorted(r["v"] for r in rows if r["side"] == "head") == [0, 1, 2]
    assert sorted(r["v"] for r in rows if r["side"] == "tail") == [17, 18, 19]


def test_competition_rank_shares_the_smaller_rank(spark):
    df = spark.createDataFrame([("m", 0.5), ("m", 0.7), ("m", 0.7), ("m", 0.1)], "m string, s double")
    rows = ranks.competition_rank(df, ["m"], F.desc("s")).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 1, 3, 4]


def test_frequent_keys_are_dealt_to_several_tasks(spark, table):
    """Without adaptive execution no task of the lookup holds all rows of the hot value."""
    present = table.where("x IS NOT NULL")
    lookup = materialise(ranks.rank_table(present, "x", count="n"), "lookup")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranks.spread_join(present, lookup, ["x"], "n")
        hot = found.where("x = 5.0").groupBy(F.spark_partition_id()).count().collect()
        rows = {r["id"]: r["avg_rank"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    total = sum(r["count"] for r in hot)
    assert total > 900 and len(hot) > 2 and max(r["count"] for r in hot) < 0.7 * total
    x = {i: v for i, _, v in hot_values() if v is not None}
    ordered = np.sort(list(x.values()))
    assert len(rows) == len(x)
    for i, v in x.items():
        low, high = np.searchsorted(ordered, v), np.searchsorted(ordered, v, side="right")
        assert rows[i] == (low + 1 + high) / 2


def test_left_lookup_keeps_rows_without_a_value(table):
    rows = ranks.average_rank(table, "x").collect()
    assert len(rows) == 3000 and sum(r["avg_rank"] is None for r in rows) == sum(
        v is None for *_, v in hot_values())


@pytest.mark.parametrize("n", [0, 1, 37, 2999, 3000, 5000])
def test_smallest_hashes_equal_a_sort(table, n):
    order = F.pmod(F.col("id") * 7919, F.lit(1009))  # with ties
    got = [r["id"] for r in split.smallest_hashes(table, n, "id", order).collect()]
    assert sorted(got) == sorted(sorted(range(3000), key=lambda i: (i * 7919 % 1009, i))[:n])


def test_best_model_excluding_one(spark):
    df = spark.createDataFrame([("a", "x", .9), ("a", "y", .7), ("a", "z", .7), ("b", "x", .4)],
                               "p string, model string, auc double")
    rows = ranks.best_excluding(df, ["p"], [F.desc("auc"), F.asc("model")], "model", "x").collect()
    assert [tuple(r) for r in rows] == [("a", "y", .7)]
