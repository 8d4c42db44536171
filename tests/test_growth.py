"""Steps whose cost must not outgrow the input."""

import re

import numpy as np
import pytest

from riskweave.functions.hashing import strong_draws
from riskweave.operators import compare, profile, ranks, resample, split
from riskweave.plans import model_queries
from riskweave.session import materialise


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [1000, 2])
def test_box_stats_by_group_never_broadcasts_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "SMALL_GROUPS", limit)  # with 2 the three groups are too many
    rng = np.random.default_rng(5)
    rows = [(int(g), float(x), None if x > 1 else float(2 * x))
            for g, x in zip(rng.integers(0, 3, 600), np.round(rng.normal(0, 1, 600), 2))]
    # a small written table: the engine takes it for the smaller side
    table = materialise(spark.createDataFrame(rows, "g int, x double, y double"), "boxes")
    found = profile.box_stats(table, ["x", "y"], by=["g"])
    builds = re.findall(r"BroadcastHashJoin .*?(BuildLeft|BuildRight)", plan(found).split("Physical Plan")[1])
    assert builds == (["BuildRight", "BuildRight"] if limit == 1000 else [])
    got = {(r["g"], r["variable"]): r for r in found.collect()}
    assert len(got) == 6
    for (g, variable), r in got.items():
        v = np.array([row[1 + (variable == "y")] for row in rows
                      if row[0] == g and row[1 + (variable == "y")] is not None])
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(q)
        inside = v[(v >= r["p25"] - 1.5 * (r["p75"] - r["p25"])) & (v <= r["p75"] + 1.5 * (r["p75"] - r["p25"]))]
        assert (r["n"], r["n_outliers"]) == (len(v), len(v) - len(inside))
        assert (r["low_whisker"], r["high_whisker"]) == (inside.min(), inside.max())


def test_every_weight_is_drawn_once_for_all_sets_with_few_scores(spark, monkeypatch):
    rng = np.random.default_rng(9)
    names = [f"s{k}" for k in range(4)]
    scores = np.round(rng.normal(0, 1, (400, 4)), 1)
    scores[:130, 0] = 0.5
    rows = [(i, int(rng.random() < 0.4), *map(float, x)) for i, x in enumerate(scores)]
    wide = spark.createDataFrame(rows * 2, "id long, label int, " + ", ".join(f"{s} double" for s in names))
    drawn = spark.sparkContext.accumulator(0)

    def draws(cells, replicates):
        drawn.add(len(cells) * len(replicates))
        return strong_draws(cells, replicates)

    def metrics(levels, group=1 << 19):
        monkeypatch.setattr(resample, "LEVELS", levels)
        monkeypatch.setattr(resample, "GROUP", group)
        found = resample.replicate_metrics(wide, names, dict.fromkeys(names, 0.2), 230, draws).collect()
        return {(r["set"], r["replicate"]): (r["auc"], r["ap"], r["f1"]) for r in found}

    got = metrics(4096)
    assert drawn.value <= 400 * 231 * 1.05  # before: twice for every set
    assert len(got) == 4 * 231
    for levels, group in ((4096, 60), (120, 1 << 19), (0, 1 << 19)):  # some or all sets by buckets
        other = metrics(levels, group)
        assert other.keys() == got.keys()
        for key, value in other.items():
            assert value == pytest.approx(got[key], rel=1e-9)


def test_sums_of_packed_counts_do_not_run_over():
    rng = np.random.default_rng(2)
    code = np.sort(rng.integers(0, 5, 9000))
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    order = rng.permutation(9000)
    for top in (3, 40, 60000):
        w = rng.integers(0, top, (9000, 8)).astype(np.uint16)
        assert (resample._added(w, order, starts)
                == np.add.reduceat(w[order].astype(np.int64), starts, axis=0)).all()


@pytest.mark.parametrize("n", [1, 3, 500, 70_000])
def test_counts_invert_the_distribution_function(n):
    low, cdf = resample.poisson_cdf(n)
    u = np.concatenate([np.random.default_rng(1).random(20_000), cdf[cdf < 1], [0.0, 1 - 2.0 ** -53]])
    assert (resample._counts(u, n) == low + np.searchsorted(cdf, u, side="right")).all()


def test_long_to_wide_groups_once_by_observation(spark):
    rows = [(p, m, i, i % 2, None if i == 3 and m == "m2" else float(10 * i + k))
            for i in range(50) for k, (p, m) in enumerate((("a", "m1"), ("a", "m2"), ("b", "m1")))
            if (i, k) != (7, 2)]
    long = spark.createDataFrame(rows, "pipeline string, model string, id long, label int, score double")
    wide = compare.to_wide(long, ["a_m1", "a_m2", "b_m1"])
    assert wide.columns == ["id", "label", "a_m1", "a_m2", "b_m1"]
    assert plan(wide).split("Physical Plan")[1].count("Exchange hashpartitioning") == 1
    got = {r["id"]: tuple(r)[1:] for r in wide.collect()}
    assert got == {i: (i % 2, 10.0 * i, None if i == 3 else 10.0 * i + 1, None if i == 7 else 10.0 * i + 2)
                   for i in range(50)}


def test_long_to_wide_does_not_depend_on_the_order_of_repeated_rows(spark):
    rows = [("a", "m1", 1, 0, 0.2), ("a", "m1", 1, 0, 0.9)]
    schema = "pipeline string, model string, id long, label int, score double"
    for some in (rows, rows[::-1]):
        wide = compare.to_wide(spark.createDataFrame(some, schema).coalesce(1), ["a_m1"])
        assert [tuple(r) for r in wide.collect()] == [(1, 0, 0.9)]


def test_split_and_folds_are_assigned_without_a_join_of_rows(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, int(rng.random() < 0.3), float(i % 7)) for i in range(900)],
                                 "id long, target int, x double")
    direct = split.with_stratified_split(rows)
    assert "SortMergeJoin" not in plan(direct).split("Physical Plan")[1]
    joined = split.attach_split(rows, split.stratified_split(rows))
    assert sorted(map(tuple, direct.select("id", "target", "x", "split").collect())) == sorted(
        map(tuple, joined.select("id", "target", "x", "split").collect()))


def test_model_input_is_made_where_the_rows_are(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(model_queries, "materialise", lambda df, name, *rest: joins.append(
        plan(df).split("Physical Plan")[1].count("SortMergeJoin")) or materialise(df, name, *rest))
    monkeypatch.setattr(model_queries, "_SPLIT", {})
    train_rows, test_rows = model_queries.ml_tables(spark, "/root/testdata/sf0.001")
    assert joins == [0, 0, 0]  # rows with split, train, test
    assert train_rows.columns == ["id", "label", "features", "fold"]
    per = {r["fold"]: r["count"] for r in train_rows.groupBy("fold").count().collect()}
    assert sorted(per) == [0, 1, 2] and max(per.values()) - min(per.values()) <= 2
