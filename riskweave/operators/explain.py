"""Local explanations of single predictions, for many rows in one job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import strong_uniform
from riskweave.operators.ranks import (default_buckets, exact_quantiles, rank_table, spread_join,
                                       unpivot)
from riskweave.operators.train import score_column
from riskweave.session import materialise


def hard_cases(wide: DataFrame, first: str, second: str, thresholds: Column) -> DataFrame:
    """Rows both score sets get wrong, with the mean percent rank of their two scores.

    Ranks are computed over all rows; only the wrong rows look theirs up.
    """
    ranks = [materialise(rank_table(wide.select(s), s, out=f"_r{i}", percent=True, count="_rows"),
                         "ranks") for i, s in enumerate((first, second))]
    p1, p2 = (F.col(s) >= thresholds[s] for s in (first, second))
    wrong = wide.select("id", "label", first, second, p1.alias("p1"), p2.alias("p2")).filter(
        (F.col("p1") == F.col("p2")) & (F.col("p1").cast("int") != F.col("label")))
    for s, r in zip((first, second), ranks):
        wrong = spread_join(wrong, r, [s], "_rows").drop("_rows")
    kind = F.when(F.col("label") == 1, "false negative").otherwise("false positive")
    return wrong.select("id", kind.alias("kind"), first, second,
                        ((F.col("_r0") + F.col("_r1")) / 2).alias("mean_rank"))


def clearest_cases(cases: DataFrame) -> DataFrame:
    """The lowest-ranked false negative and the highest-ranked false positive, smallest id on ties."""
    signed = F.when(F.col("kind") == "false negative", F.col("mean_rank")).otherwise(
        -F.col("mean_rank"))
    best = F.min_by(F.struct("id", "mean_rank"), F.struct(signed, F.col("id"))).alias("b")
    return cases.groupBy("kind").agg(best, F.count(F.lit(1)).alias("n")).select("kind", "n", "b.*")


def reference_summary(train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """What perturbation needs to know: quartile bins of numerics, frequencies of categories.

    One row per (variable, bin or category), from the full table. A value belongs to the bin given
    by the number of distinct quartiles below it.
    """
    cuts = exact_quantiles(train, numeric, [0.25, 0.5, 0.75]).select(
        "variable", F.array_distinct("q").alias("cuts"))
    # one row per numeric column
    long = unpivot(train, numeric).join(F.broadcast(cuts), "variable")
    binned = long.withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    bins = binned.groupBy("variable", "bin").agg(
        F.first("cuts").alias("cuts"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("lo"),
        F.max("value").alias("hi")).withColumn("level", F.lit(None).cast("string"))
    if not categorical:
        return bins
    texts = train.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [], categorical, "variable", "level").filter(F.col("level").isNotNull())
    levels = texts.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    return bins.unionByName(levels, allowMissingColumns=True)


def _bins(found: list, numeric: bool) -> tuple[Column, Column]:
    """Cumulative shares below each bin but the first, and the bins themselves, as constants."""
    total = sum(r["n"] for r in found)
    upto = np.cumsum([r["n"] / total for r in found])[:-1]
    if numeric:
        bins = [F.struct(F.lit(r["bin"]).alias("bin"), *[
            F.lit(float(r[k])).alias(k) for k in ("mean", "sd", "lo", "hi")]) for r in found]
    else:
        bins = [F.struct(F.lit(r["level"]).alias("level")) for r in found]
    return F.array(*[F.lit(float(c)) for c in upto]).cast("array<double>"), F.array(*bins)


def perturb(instances: DataFrame, summary: list, numeric: list[str], categorical: list[str],
            samples: int, seed: Column) -> DataFrame:
    """``samples`` neighbours of every instance, with a 0/1 vector of unchanged features.

    Sample 0 is the instance itself. For the others each feature draws a bin (or category) with
    its train frequency and a numeric value around that bin's mean, kept inside the bin. All draws
    are hashes of (instance, seed, sample, feature), so a retried task repeats them.
    """
    variables = [*numeric, *categorical]
    found = {c: sorted((r for r in summary if r["variable"] == c),
                       key=lambda r: r["bin"] if r["level"] is None else r["level"])
             for c in variables}
    rows = instances.withColumn("_seed", seed).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def u(slot: int, draw: int) -> Column:
        return strong_uniform(F.col("id"), F.col("_seed"), F.col("_k"), F.lit(slot), F.lit(draw))

    # the uniform, the drawn bin and the value are separate projections: each is used repeatedly
    rows = rows.withColumns({f"_u{i}": u(i, 0) for i in range(len(variables))})
    picks = {}
    for i, c in enumerate(variables):
        upto, bins = _bins(found[c], c in numeric)
        below = F.size(F.filter(upto, _reached(f"_u{i}")))
        picks[f"_b{i}"] = F.element_at(bins, below + 1)
        if c in numeric:
            # here, not in the final select: there the name would mean the drawn value
            picks[f"_o{i}"] = F.size(F.filter(
                F.array(*[F.lit(float(q)) for q in found[c][0]["cuts"]]), _below(c)))
    rows = rows.withColumns(picks)
    same, drawn, original = [], {}, F.col("_k") == 0
    for i, c in enumerate(variables):
        pick = F.col(f"_b{i}")
        if c in numeric:
            normal = F.sqrt(-2 * F.log(F.greatest(u(i, 1), F.lit(1e-300)))) * F.cos(
                2 * F.pi() * u(i, 2))
            value = F.least(pick["hi"], F.greatest(pick["lo"], pick["mean"] + normal * pick["sd"]))
            match = pick["bin"] == F.col(f"_o{i}")
        else:
            value = pick["level"].cast(instances.schema[c].dataType)
            match = pick["level"] == F.col(c).cast("string")
        same.append(F.when(original, 1.0).otherwise(F.coalesce(match, F.lit(False)).cast("double")))
        drawn[c] = F.when(original, F.col(c)).otherwise(value)
    others = [c for c in [*instances.columns, "_seed", "_k"] if c not in drawn]
    return rows.select(*others, *[v.alias(c) for c, v in drawn.items()],
                       F.array(*same).alias("_z"))


def _below(column: str):
    return lambda cut: cut < F.col(column)


def _reached(column: str):
    return lambda cut: cut <= F.col(column)


def conditions(instances: DataFrame, summary: list, numeric: list[str],
               categorical: list[str]) -> DataFrame:
    """Readable condition of every feature of every instance: 'x <= 3', '3 < x <= 5', 'c=A'."""
    cuts = {r["variable"]: r["cuts"] for r in summary if r["cuts"] is not None}
    texts = []
    for c in numeric:
        q = cuts[c]
        expr = F.when(F.col(c) <= q[0], f"{c} <= {q[0]:.2f}")
        for low, high in zip(q, q[1:]):
            expr = expr.when(F.col(c) <= high, f"{low:.2f} < {c} <= {high:.2f}")
        texts.append(expr.otherwise(f"{c} > {q[-1]:.2f}"))
    texts += [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categorical]
    return instances.select("id", F.posexplode(F.array(*texts)).alias("slot", "condition"))


def _gram(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted cross products of (1, z, y), proximity as weight; grams of parts add up."""
    width = 0.75 * np.sqrt(z.shape[1])
    w = np.sqrt(np.exp(-(1 - z).sum(axis=1) / width ** 2))
    rows = np.column_stack([np.ones(len(z)), z, y])
    return (rows * w[:, None]).T @ rows


def _solved(gram: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(features used, their coefficients, r2, prediction at the instance) from a gram matrix.

    A ridge fit of all features chooses the strongest ones, a second one fits those alone; both need
    no more than the sums.
    """
    size = gram[0, 0]
    mean = gram[0, 1:] / size
    centred = gram[1:, 1:] - size * np.outer(mean, mean)
    zz, zy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    first = np.linalg.solve(zz + 0.01 * np.eye(len(zz)), zy)
    used = np.sort(np.argsort(-np.abs(first), kind="stable")[:top])
    part, target = zz[np.ix_(used, used)], zy[used]
    coef = np.linalg.solve(part + np.eye(len(used)), target)
    left = yy - 2 * coef @ target + coef @ part @ coef
    # the instance has every feature unchanged
    here = mean[-1] - mean[:-1][used] @ coef + coef.sum()
    return used, coef, float(1 - left / yy) if yy > 0 else 0.0, float(here)


def _gram_rows(batches):
    """One gram for each (id, seed, model) of a batch, and the instance's own prediction."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in ("id", "_seed", "model")]
        keys = pd.MultiIndex.from_arrays([c.to_pandas() for c in columns])
        codes, known = keys.factorize()
        z = np.vstack(batch.column("_z").to_numpy(zero_copy_only=False))
        y = batch.column("_p").to_numpy()
        own = batch.column("_k").to_numpy() == 0
        made = []
        for k, key in enumerate(known):
            at = codes == k
            gram = _gram(z[at], y[at])
            mine = y[at & own]
            made.append((*key, gram.ravel(), float(mine[0]) if len(mine) else None))
        ids, seeds, models, grams, mine = zip(*made)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(seeds, pa.int32()), pa.array(models, pa.string()),
             pa.array(grams, pa.list_(pa.float64())), pa.array(mine, pa.float64())],
            names=["id", "seed", "model", "gram", "own"])


def _fitted_group(pdf: pd.DataFrame, top: int) -> pd.DataFrame:
    """The fit of one (id, seed, model) from the grams of its parts."""
    gram = np.sum(np.vstack(pdf["gram"]), axis=0)
    size = int(round(len(gram) ** 0.5))
    used, coef, r2, here = _solved(gram.reshape(size, size), top)
    return pd.DataFrame({
        "id": pdf["id"].iloc[0], "seed": pdf["seed"].iloc[0], "model": pdf["model"].iloc[0],
        "slot": used, "weight": coef, "r2": r2, "local_prediction": here,
        "model_prediction": pdf["own"].max()})


def lime_models(instances: DataFrame, fitted: dict[str, tuple], train: DataFrame,
                numeric: list[str], categorical: list[str], samples: int = 5000, top: int = 10,
                seeds: list[int] = (42,)) -> DataFrame:
    """Top conditions with weights for every model, instance and seed.

    ``fitted`` maps a name to (pipeline model, score column). All models score the same neighbours,
    which are drawn and written once. A fit needs its neighbours only through weighted sums, so every
    batch reduces them to one matrix per (instance, seed, model) and only those meet.
    """
    # bins and categories per feature, never rows
    summary = reference_summary(train, numeric, categorical).collect()
    empty = set(numeric) - {r["variable"] for r in summary}
    if empty:
        raise ValueError(f"numeric columns without any value: {', '.join(sorted(empty))}")
    filled = _fill(instances, train, numeric)
    per_seed = filled.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in seeds])))
    near = perturb(per_seed, summary, numeric, categorical, samples, F.col("_s"))
    # a few instances become many rows to score: spread them over all tasks
    near = near.repartition(default_buckets(near.sparkSession))
    if len(fitted) > 1:
        near = materialise(near, "neighbours")
    scored = [model.transform(near).select(
        F.col("id").cast("long"), F.col("_seed").cast("int"), F.lit(name).alias("model"), "_k", "_z",
        score_column(column).cast("double").alias("_p")) for name, (model, column) in fitted.items()]
    grams = reduce(DataFrame.unionByName, scored).mapInArrow(
        _gram_rows, "id long, seed int, model string, gram array<double>, own double")
    fits = grams.groupBy("id", "seed", "model").applyInPandas(
        lambda pdf: _fitted_group(pdf, top),
        "id long, seed int, model string, slot int, weight double, r2 double,"
        " local_prediction double, model_prediction double")
    return fits.join(conditions(filled, summary, numeric, categorical), ["id", "slot"])


def lime_batch(instances: DataFrame, fitted, train: DataFrame, numeric: list[str],
               categorical: list[str], column: str = "probability", samples: int = 5000,
               top: int = 10, seeds: list[int] = (42,)) -> DataFrame:
    """``lime_models`` of one model."""
    return lime_models(instances, {"model": (fitted, column)}, train, numeric, categorical, samples,
                       top, seeds).drop("model")


def _fill(instances: DataFrame, train: DataFrame, numeric: list[str]) -> DataFrame:
    medians = exact_quantiles(train, numeric, [0.5], method="observed")
    lookup = medians.agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.col("q")[0]))).alias("m")).scalar()
    return instances.withColumns({c: F.coalesce(F.col(c), lookup[c]) for c in numeric})


def compare_explanations(left: DataFrame, right: DataFrame) -> DataFrame:
    """Weights of two explanations side by side, per (id, condition); missing ones are NULL."""
    a = left.select("id", "condition", F.col("weight").alias("weight_left"))
    b = right.select("id", "condition", F.col("weight").alias("weight_right"))
    return a.join(b, ["id", "condition"], "full_outer")


def explanation_overlap(aligned: DataFrame) -> DataFrame:
    """Common conditions and Jaccard index per id."""
    both = F.col("weight_left").isNotNull() & F.col("weight_right").isNotNull()
    return aligned.groupBy("id").agg(
        F.count_if(both).alias("common"), F.count(F.lit(1)).alias("either"),
        (F.count_if(both) / F.count(F.lit(1))).alias("jaccard"))


def condition_stability(explanations: DataFrame, runs: int) -> DataFrame:
    """In how many of the seeded runs each condition of an instance appears."""
    return explanations.groupBy("id", "condition").agg(
        F.count_distinct("seed").alias("runs")).withColumn("in_all", F.col("runs") == runs)
