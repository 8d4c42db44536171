"""Classifiers, grid search with stratified folds, and fit records.

The ensembles are searched in stages: a boosted model of 50 trees is the first half of one of 100, and
the first 10 trees of a forest are a forest of 10 (one with other draws than a separate fit of 10
would make). Trees grow from the root, so a tree of depth 15 cut at depth 5 is the tree of depth 5 (in a
forest, one with other draws of features); boosted trees depend on the ones before and are not cut. So
only the largest number of trees and the largest depth are fitted for each other grid point and fold,
and one scoring pass finds the leaves of a row and keeps the score at every wanted number and depth.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.evaluate import auc
from riskweave.session import materialise, scratch_path, ship
from riskweave.sources import results

# The regularisation grid shared by the linear models.
REG_PARAMS = [1e-6, 1e-5, 1e-4]
SEED = 42


@dataclass
class Candidate:
    """An estimator, its grid, the column its score comes from, and the parameters whose smaller
    values are part of a fit with the largest one: the number of trees and the depth."""

    estimator: Estimator
    grid: dict[str, list] = field(default_factory=dict)
    score: str = "probability"
    staged: str | None = None
    nested: str | None = None

    def param_maps(self) -> list[dict]:
        builder = ParamGridBuilder()
        for name, values in self.grid.items():
            builder = builder.addGrid(self.estimator.getParam(name), values)
        return builder.build()


def candidates(n_features: int, seed: int = SEED) -> dict[str, Candidate]:
    """The six classifiers with their full grids, and the probability-tree variants.

    The tree classifier merges sibling leaves that predict the same class, which flattens the
    ranking of a shallow tree on unbalanced data. The regressors fit the same splits (variance and
    Gini impurity order splits alike for a 0/1 label) and keep every leaf mean as a probability.
    """
    subset = str(max(1, int(n_features ** 0.5)))
    trees = {"maxDepth": [5, 10, 15]}
    return {
        "LogisticRegression": Candidate(
            LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=100),
            {"regParam": REG_PARAMS}),
        "DecisionTree": Candidate(DecisionTreeClassifier(maxBins=32, seed=seed), trees,
                                  nested="maxDepth"),
        "ProbabilityTree": Candidate(DecisionTreeRegressor(maxBins=32, seed=seed), trees,
                                     "prediction", nested="maxDepth"),
        "RandomForest": Candidate(
            RandomForestClassifier(featureSubsetStrategy=subset, maxBins=32, seed=seed,
                                   cacheNodeIds=True),
            {"numTrees": [10, 50, 100], **trees}, staged="numTrees", nested="maxDepth"),
        "ProbabilityForest": Candidate(
            RandomForestRegressor(featureSubsetStrategy=subset, maxBins=32, seed=seed,
                                  cacheNodeIds=True),
            {"numTrees": [10, 50, 100], **trees}, "prediction", "numTrees", "maxDepth"),
        "GradientBoosting": Candidate(
            GBTClassifier(stepSize=0.1, maxBins=32, seed=seed, cacheNodeIds=True),
            {"maxIter": [50, 100], "maxDepth": [3, 5]}, staged="maxIter"),
        "LinearSVC": Candidate(LinearSVC(standardization=False, maxIter=100),
                               {"regParam": REG_PARAMS}, "rawPrediction"),
        "NaiveBayes": Candidate(NaiveBayes(modelType="gaussian"), {}),
    }


def score_column(column: str) -> Column:
    """Score of class 1 from an output column of a fitted model."""
    return F.col(column) if column == "prediction" else vector_to_array(F.col(column))[1]


def score_with(model, df: DataFrame, column: str) -> DataFrame:
    return model.transform(df).select("id", F.col("label").cast("int").alias("label"),
                                      score_column(column).alias("score"))


def evaluator(column: str) -> BinaryClassificationEvaluator:
    """Area under the ROC curve without score binning."""
    return BinaryClassificationEvaluator(rawPredictionCol=column, labelCol="label", numBins=0)


def default_threshold(column: str) -> float:
    """Where a score calls class 1 without a fitted threshold: 0 for margins, else one half."""
    return 0.0 if column == "rawPrediction" else 0.5


@dataclass
class Tuned:
    """Best model of a grid search, the grid table, its cost and the best point."""

    model: object
    grid: DataFrame
    column: str
    seconds: float
    best: dict
    fits: int = 0
    iterations: int | None = None

    def scores(self, df: DataFrame) -> DataFrame:
        return score_with(self.model, df, self.column)


def _cut_values(nodes: pd.DataFrame, depths: list[int | None], share: bool
                ) -> tuple[np.ndarray, list[int]]:
    """(depths, leaves): what every leaf of a tree stands for when the tree is cut at each depth; and
    the number of leaves that each cut leaves.

    Nodes are numbered from the root, left before right, and so are the leaves. With share a node stands
    for its share of class 1, and the classifier's rule applies: a subtree whose leaves all predict the
    same class is one leaf.
    """
    nodes = nodes.sort_values("id")
    left, right = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    called, inner = nodes["prediction"].to_numpy(), left >= 0
    depth = np.zeros(len(left), dtype=np.int64)
    for k in np.flatnonzero(inner):  # parents come before their children
        depth[left[k]] = depth[right[k]] = depth[k] + 1
    value = called
    if share:
        counts = np.array(nodes["impurityStats"].tolist())
        value = counts[:, 1] / counts.sum(axis=1)
    levels = [np.flatnonzero(inner & (depth == d)) for d in range(int(depth.max()) + 1)]
    out, left_over = [], []
    for most in depths:
        limit = len(levels) if most is None else most
        ends = ~inner | (depth >= limit)
        if share:
            for at in reversed(levels[:limit]):
                a, b = left[at], right[at]
                ends[at] = ends[a] & ends[b] & (called[a] == called[b])
        kept = value.copy()
        done, gone = ends.copy(), np.zeros(len(left), dtype=bool)
        for at in levels:
            for child in (left[at], right[at]):
                kept[child] = np.where(done[at], kept[at], kept[child])
                gone[child] = done[at]
                done[child] |= done[at]
        out.append(kept[~inner])
        left_over.append(int((ends & ~gone).sum()))
    return np.array(out), left_over


def cut_trees(model, depths: list[int | None]) -> list[tuple[np.ndarray, list[int]]]:
    """``_cut_values`` of every tree of a fitted model, in the order of the trees.

    The stored nodes are read and each tree is worked on in a task; what comes back is smaller than the
    trees, which the driver holds.
    """
    spark = SparkSession.active()
    ship(spark)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    share = "RandomForestClass" in type(model).__name__ or "DecisionTreeClass" in type(model).__name__

    def values(tree: pd.DataFrame) -> pd.DataFrame:
        found, left_over = _cut_values(tree, depths, share)
        return pd.DataFrame({"tree": [int(tree["treeID"].iloc[0])], "leaves": [found.tobytes()],
                             "n": [left_over]})

    rows = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild").groupBy(
        "treeID").applyInPandas(values, "tree int, leaves binary, n array<int>").collect()  # one row per tree
    return [(np.frombuffer(r["leaves"]).reshape(len(depths), -1), r["n"]) for r in sorted(rows)]


def staged_scores(model, df: DataFrame, stages: list[int], column: str,
                  depths: list[int] | None = None) -> DataFrame:
    """(id, label, stage, score): the score of the first `stage` trees of an ensemble, and with depths
    (id, label, stage, depth, score): of the trees cut at each depth. A single tree is one stage.

    Every tree is applied once; boosted margins and forest shares are running sums over the trees.
    """
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0] * max(stages)
    tables = [t for t, _ in cut_trees(model, depths or [None])[:max(stages)]]
    first = np.cumsum([0, *[t.shape[1] for t in tables[:-1]]])
    shared = df.sparkSession.sparkContext.broadcast(np.concatenate(
        [w * t for w, t in zip(weights, tables)], axis=1))
    points = [(n, k) for n in stages for k in range(len(depths or [None]))]

    def run(batches):
        known = shared.value
        for batch in batches:
            leaf = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            at = leaf[:, :len(first)] + first
            totals = [np.cumsum(known[k][at], axis=1) for k in range(len(known))]
            for n, k in points:
                score = totals[k][:, n - 1]
                if not boosted:
                    score = score / n
                elif column == "probability":
                    score = 1 / (1 + np.exp(-2 * score))
                rows = len(score)
                columns = [batch.column(0), batch.column(1), pa.array(np.full(rows, n, np.int32))]
                if depths:
                    columns.append(pa.array(np.full(rows, depths[k], np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=names)

    names = ["id", "label", "stage", *(["depth"] if depths else []), "score"]
    schema = T.StructType([df.select("id").schema["id"], *[
        T.StructField(c, T.DoubleType() if c == "score" else T.IntegerType()) for c in names[1:]]])
    unused = {p: "" for p in (model.getParam(n) for n in ("predictionCol", "probabilityCol",
                                                          "rawPredictionCol") if model.hasParam(n))}
    leaves = model.copy({**unused, model.leafCol: "_leaf"}).transform(df)
    found = vector_to_array("_leaf") if hasattr(model, "treeWeights") else F.array("_leaf")
    return leaves.select("id", F.col("label").cast("int").alias("label"),
                         found.cast("array<int>").alias("leaf")).mapInArrow(run, schema)


#: fold -> (training rows, rows to score), each (id, label, features)
Parts = Callable[[int], tuple[DataFrame, DataFrame]]


def _fold_aucs(candidate: Candidate, maps: list[dict], parts: Parts, folds: int,
               parallelism: int, spark: SparkSession) -> tuple[np.ndarray, int]:
    """AUC of every grid point (down) in every fold (across), and the number of fits."""
    staged, nested = (candidate.estimator.getParam(n) if n else None
                      for n in (candidate.staged, candidate.nested))
    groups: dict[tuple, list[int]] = {}
    for i, point in enumerate(maps):
        other = tuple((p, v) for p, v in point.items() if p not in (staged, nested))
        groups.setdefault(other, []).append(i)
    found = np.zeros((len(maps), folds))
    rows = [parts(fold) for fold in range(folds)]

    def run(job: tuple[int, tuple]) -> None:
        fold, other = job
        fit_rows, score_rows = rows[fold]
        members = groups[other]
        largest = {p: max(maps[i][p] for i in members) for p in (staged, nested) if p is not None}
        model = candidate.estimator.fit(fit_rows, {**dict(other), **largest})
        if not largest:
            scores = score_with(model, score_rows, candidate.score).withColumns(
                {"stage": F.lit(1), "depth": F.lit(0)})
        else:
            stages = sorted({maps[i][staged] for i in members}) if staged else [1]
            depths = sorted({maps[i][nested] for i in members}) if nested else None
            scores = staged_scores(model, score_rows, stages, candidate.score, depths)
            # read several times: the trees are applied once
            scores = materialise(scores if depths else scores.withColumn("depth", F.lit(0)), "staged")
        value = {(r["stage"], r["depth"]): r["auc"]
                 for r in auc(scores, ["stage", "depth"]).collect()}  # one row per point
        for i in members:
            found[i, fold] = value[maps[i][staged] if staged else 1, maps[i][nested] if nested else 0]

    jobs = [(fold, other) for other in groups for fold in range(folds)]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        pool.map(inheritable_thread_target(spark)(run), jobs, chunksize=1)
    return np.round(found, 12), len(jobs)  # sums in another order are no better point


def _storage(spark: SparkSession) -> int:
    """Bytes that the executors can cache."""
    context = spark.sparkContext._jsc.sc()
    driver = context.env().blockManager().blockManagerId().hostPort()
    entries = context.getExecutorMemoryStatus().iterator()
    room = {}
    while entries.hasNext():
        entry = entries.next()
        room[entry._1()] = entry._2()._1()
    return sum(v for k, v in room.items() if k != driver or len(room) == 1)


def fits_at_once(candidate: Candidate, train: DataFrame, parallelism: int, storage: int) -> int:
    """Fits to run at the same time, one at least: every fit caches its rows in a form of its own, some
    eight bytes for a feature and for a tree, and together they should fit what executors can cache."""
    names = candidate.estimator.extractParamMap()
    trees = max(candidate.grid.get("numTrees", []), default=0) if any(
        p.name == "numTrees" for p in names) else 0
    first = train.select("features").first() if "features" in train.columns else None
    width = first[0].size if first else 4 * len(train.columns)
    need = 8 * (width + trees) * max(train.count(), 1)
    return max(1, min(parallelism, storage // need))


def tune(name: str, candidate: Candidate, train: DataFrame, folds: int = 3,
         fold_col: str | None = None, parallelism: int = 1, seed: int = SEED,
         pipelines: list[PipelineModel] | None = None) -> Tuned:
    """Grid search by cross-validated AUC, refit of the best point on all rows.

    With ``fold_col`` the folds are given (stratified); otherwise they are random. The input should be a
    written table, which every fit reads twice; it is not cached here, because a fit caches its rows
    itself in the form it iterates over. `parallelism` fits run at the same time if what they cache has
    room (``fits_at_once``). ``pipelines`` (from
    ``features.fold_pipelines``, then `train` has raw rows with id and label) puts the feature
    pipeline inside the folds: no fit sees a parameter learned on the rows it is scored on.
    """
    maps = candidate.param_maps()
    spark = train.sparkSession
    start = time.perf_counter()
    if fold_col or candidate.staged or candidate.nested or pipelines:
        parallelism = fits_at_once(candidate, train, parallelism, _storage(spark))
        if not fold_col:
            fold_col = "_fold"
            train = train.withColumn(fold_col, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)))

        def parts(fold: int) -> tuple[DataFrame, DataFrame]:
            both = train.where(F.col(fold_col) != fold), train.where(F.col(fold_col) == fold)
            if not pipelines:
                return both
            return tuple(materialise(pipelines[fold].transform(x).select("id", "label", "features"),
                                     f"fold{fold}") for x in both)

        aucs, fits = _fold_aucs(candidate, maps, parts, folds, parallelism, spark)
        means, spreads = aucs.mean(axis=1), aucs.std(axis=1)
        whole = train if not pipelines else materialise(
            pipelines[folds].transform(train).select("id", "label", "features"), "all_folds")
        model = candidate.estimator.fit(whole, maps[int(np.argmax(means))])
    else:
        cv = CrossValidator(estimator=candidate.estimator, estimatorParamMaps=maps,
                            evaluator=evaluator(candidate.score), numFolds=folds, seed=seed,
                            parallelism=parallelism)
        fitted = cv.fit(train)
        means, spreads, model = fitted.avgMetrics, fitted.stdMetrics, fitted.bestModel
        fits = folds * len(maps)
    seconds = time.perf_counter() - start
    rows = [(name, i, ", ".join(f"{p.name}={v}" for p, v in m.items()) or "default",
             float(mean), float(std)) for i, (m, mean, std) in enumerate(zip(maps, means, spreads))]
    grid = spark.createDataFrame(
        rows, "model string, point int, params string, mean_auc double, std_auc double")
    best = max(rows, key=lambda r: (r[3], -r[1]))
    return Tuned(model, grid, candidate.score, seconds,
                 {p.name: v for p, v in maps[best[1]].items()}, fits + 1, iterations(model))


def tune_stored(store: str, name: str, candidate: Candidate, train: DataFrame, folds: int = 3,
                fold_col: str | None = None, parallelism: int = 1, seed: int = SEED,
                force: bool = False) -> Tuned:
    """``tune`` with results kept below the folder `store`: a search whose rows, estimator, grid and
    folds are known is read instead of fitted, unless `force` asks for a new fit that replaces it."""
    spark = train.sparkSession
    params = {p.name: str(v) for p, v in candidate.estimator.extractParamMap().items()}
    key = results.digest(name, type(candidate.estimator).__name__, params, candidate.grid,
                         candidate.score, candidate.staged, candidate.nested, folds, fold_col, seed,
                         results.fingerprint(train))
    path = f"{store}/{name}-{key}"
    if force or not results.exists(spark, path):
        made = tune(name, candidate, train, folds, fold_col, parallelism, seed)

        def write(place: str) -> None:
            made.grid.coalesce(1).write.parquet(f"{place}/grid")
            PipelineModel([made.model]).write().save(f"{place}/model")
            spark.createDataFrame(
                [(made.column, made.seconds, made.fits, made.iterations, json.dumps(made.best))],
                "column string, seconds double, fits int, iterations int, best string").coalesce(
                1).write.parquet(f"{place}/record")
        results.publish(spark, path, write, replace=force)
    record = spark.read.parquet(f"{path}/record").first()
    return Tuned(PipelineModel.load(f"{path}/model").stages[0], spark.read.parquet(f"{path}/grid"),
                 record["column"], record["seconds"], json.loads(record["best"]), record["fits"],
                 record["iterations"])


def iterations(model) -> int | None:
    """Optimiser iterations of a linear model, None for the others."""
    summary = getattr(model, "summary", None)
    if callable(summary):
        summary = summary()
    return getattr(summary, "totalIterations", None) if summary is not None else None


def inspect_model(model) -> dict:
    """Nodes and leaves of a tree, norm and intercept of a linear model."""
    if hasattr(model, "numNodes"):
        # every inner node has two children
        return {"nodes": model.numNodes, "leaves": (model.numNodes + 1) // 2, "depth": model.depth}
    if hasattr(model, "coefficients"):
        return {"norm": float(model.coefficients.norm(2)), "intercept": float(model.intercept),
                "iterations": iterations(model)}
    return {}


def with_balance_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weights that give both classes half of the total, from one aggregate."""
    share = df.agg(F.avg(label).alias("p")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def pending(requested: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requested fits that have no stored result yet."""
    return requested.join(results.select(*keys), keys, "left_anti")
