"""Split, feature pipeline, training, scoring, explanations and experiments."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import MODULUS, portable_hash
from riskweave.operators import (compare, equiv, evaluate, experiments, explain, features, profile,
                                 split, train)
from riskweave.plans.base import CATEGORICAL, FLAGS, NUMERIC, ORDERS, prepared, table
from riskweave.plans.registry import (BASE_SQL, CAT, FLAG, NUM, portable_sql, query, rounded, tidy)
from riskweave.session import materialise, scratch_folder, scratch_path, spread
from riskweave.sources import scores as score_store
from riskweave.sources import tables

_BLOCK = [*NUM, *FLAG]

SPLIT_SQL = BASE_SQL + f""", hashed AS (SELECT *, {portable_sql('id', '0')} AS h FROM base),
ordered AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h, id) AS r,
  count(*) OVER (PARTITION BY target) AS c FROM hashed),
split AS (SELECT * EXCLUDE (r, c, h), CASE WHEN r <= round(0.2 * c) THEN 'test' ELSE 'train' END AS split,
  (r > round(c / 3e0))::INTEGER + (r > round(2 * c / 3e0))::INTEGER AS fold FROM ordered),
train AS (SELECT * FROM split WHERE split = 'train')
"""


def split_table(spark, sf) -> DataFrame:
    """(id, target, split) by the portable hash, so that SQL can repeat it."""
    return split.stratified_split(prepared(spark, sf), order=portable_hash(F.col("id")),
                                  space=float(MODULUS))


_SPLIT: dict[tuple[str, str], DataFrame] = {}


def with_split(spark, sf) -> DataFrame:
    """Base with its split, written once with a folder per part, so that train and test reads are
    pruned and every later step sees the same membership. Rows are compared with the cuts where they
    are; nothing is shuffled."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPLIT:
        _SPLIT[key] = materialise(
            split.with_stratified_split(spread(prepared(spark, sf)), order=portable_hash(F.col("id")),
                                        space=float(MODULUS)), "with_split", ["split"])
    return _SPLIT[key]


@query("stratified_split", SPLIT_SQL + "SELECT id, target, split FROM split")
def stratified_split(spark, sf):
    return split_table(spark, sf)


@query("stratified_split_audit", SPLIT_SQL + f"""
SELECT split, count(*) AS n, sum(target)::BIGINT AS positives, {rounded('avg(target) AS rate')}
FROM split GROUP BY 1""")
def stratified_split_audit(spark, sf):
    return tidy(profile.split_audit(split_table(spark, sf), "split", "target"))


@query("stratified_folds", SPLIT_SQL + """
SELECT fold, target, count(*) AS n, sum(id)::BIGINT AS id_sum FROM split GROUP BY 1, 2""")
def stratified_folds(spark, sf):
    folds = split.stratified_folds(prepared(spark, sf).select("id", "target"), 3,
                                   order=portable_hash(F.col("id")), space=float(MODULUS))
    return folds.groupBy("fold", "target").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("id").alias("id_sum"))


@query("base_with_split", SPLIT_SQL + """
SELECT split, issue_year, count(*) AS n FROM split GROUP BY 1, 2""")
def base_with_split(spark, sf):
    return with_split(spark, sf).groupBy("split", "issue_year").agg(F.count(F.lit(1)).alias("n"))


_RARE_SQL = SPLIT_SQL + ", freq AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM train GROUP BY 2"
    for c in ORDERS.rare) + """),
kept AS (SELECT * FROM freq WHERE n / (SELECT count(*) FROM train)::DOUBLE >= 0.04)
"""


@query("frequent_categories", _RARE_SQL + "SELECT variable, value, n FROM kept")
def frequent_categories(spark, sf):
    return features.frequent_categories(split.only(with_split(spark, sf), "train"),
                                        list(ORDERS.rare), ORDERS.rare_share)


_GROUPED_SQL = _RARE_SQL + f""", grouped AS (SELECT * EXCLUDE ({', '.join(ORDERS.rare)}), {', '.join(
    f"CASE WHEN {c} IN (SELECT value FROM kept WHERE variable = '{c}') THEN {c} ELSE '{o}' END AS {c}"
    for c, o in ORDERS.rare.items())} FROM split)
"""


@query("rare_grouping", _GROUPED_SQL + """
SELECT split, nation, return_flag, count(*) AS n FROM grouped GROUP BY 1, 2, 3""")
def rare_grouping(spark, sf):
    data = with_split(spark, sf)
    grouper = features.RareGrouper(inputCols=list(ORDERS.rare), others=list(ORDERS.rare.values()),
                                   minShare=ORDERS.rare_share)
    fitted = grouper.fit(data.filter(F.col("split") == "train"))
    return fitted.transform(data).groupBy("split", "nation", "return_flag").agg(
        F.count(F.lit(1)).alias("n"))


_MEDIAN_SQL = SPLIT_SQL + ", med AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, quantile_disc({c}, 0.5) AS lower, quantile_cont({c}, 0.5) AS midpoint"
    f" FROM train" for c in _BLOCK) + ")"


@query("train_medians", _MEDIAN_SQL + f" SELECT variable, {rounded('lower', 'midpoint')} FROM med")
def train_medians(spark, sf):
    rows = split.only(with_split(spark, sf), "train")
    low = features.column_medians(rows, _BLOCK, "lower").withColumnRenamed("median", "lower")
    mid = features.column_medians(rows, _BLOCK, "midpoint").withColumnRenamed("median", "midpoint")
    return tidy(low.join(mid, "variable"))


_FILLED = ", ".join(f"coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM train)) AS {c}"
                    for c in _BLOCK)


@query("impute_scale", SPLIT_SQL + f", filled AS (SELECT {_FILLED} FROM train), s AS ("
       + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, (SELECT quantile_disc({c}, 0.5) FROM train) AS median,"
    f" avg({c}) AS mean, stddev_samp({c}) AS std FROM filled" for c in _BLOCK)
    + f") SELECT variable, {rounded('median', 'mean', 'std')} FROM s")
def impute_scale(spark, sf):
    return tidy(features.scaling_parameters(split.only(with_split(spark, sf), "train"), _BLOCK))


_FOLD_PARTS = " UNION ALL ".join(
    f"SELECT {f} AS part, * FROM split WHERE fold <> {f}" for f in range(3)) + (
    " UNION ALL SELECT 3, * FROM split")


@query("fold_parameters", SPLIT_SQL + f", parts AS ({_FOLD_PARTS}), med AS (" + " UNION ALL ".join(
    f"SELECT part, '{c}' AS variable, quantile_disc({c}, 0.5) AS median FROM parts GROUP BY 1"
    for c in _BLOCK) + "), vals AS (" + " UNION ALL ".join(
    f"SELECT part, '{c}' AS variable, {c} AS value FROM parts" for c in _BLOCK) + f""")
SELECT part, variable, {rounded('any_value(median) AS median', 'avg(coalesce(value, median)) AS mean',
                                'stddev_samp(coalesce(value, median)) AS std')}
FROM vals JOIN med USING (part, variable) GROUP BY 1, 2""")
def fold_parameters(spark, sf):
    """Imputation and scaling of every training part of three folds, from one summary per fold."""
    rows = split.stratified_folds(prepared(spark, sf), 3, order=portable_hash(F.col("id")),
                                  space=float(MODULUS))
    return tidy(features.fold_parameters(rows, _BLOCK, "fold", 3))


_FITTED: dict[tuple[str, str], PipelineModel] = {}


def _fitted(spark, sf):
    """Rows with their split, and the feature pipeline fitted on train, once per session."""
    data = with_split(spark, sf)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = features.build_pipeline(ORDERS).fit(split.only(data, "train"))
    return data, _FITTED[key]


_STD = [f"({c} - (SELECT avg({c}) FROM filled_train)) / (SELECT stddev_samp({c}) FROM filled_train)"
        for c in _BLOCK]


@query("vector_means", _GROUPED_SQL + f""", f AS (SELECT split, {_FILLED}, {', '.join(CAT)} FROM grouped),
filled_train AS (SELECT * FROM f WHERE split = 'train'),
filled_test AS (SELECT * FROM f WHERE split = 'test'),
m AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, avg({e}) AS mean FROM filled_test"
                         for c, e in zip(_BLOCK, _STD))} UNION ALL {' UNION ALL '.join(
    f"SELECT '{c}_' || lv.{c} AS variable, (SELECT avg((t.{c} = lv.{c})::INTEGER) FROM filled_test t)"
    f" AS mean FROM (SELECT DISTINCT {c} FROM filled_train) lv" for c in CAT)})
SELECT variable, {rounded('mean')} FROM m""")
def vector_means(spark, sf):
    """Column means of the assembled vector on test: scaled numerics and one-hot columns."""
    data, fitted = _fitted(spark, sf)
    test = features.model_input(fitted, split.only(data, "test"))
    names = features.feature_names(fitted, ORDERS)
    return tidy(features.vector_means(test, names))


@query("learned_parameter_gaps", SPLIT_SQL + f", filled AS (SELECT {_FILLED} FROM train), s AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS mean, stddev_samp({c}) AS std"
                            f" FROM filled" for c in _BLOCK)
       + f") SELECT variable, {rounded('mean', 'std', 'mean AS mean_right', 'std AS std_right')} FROM s")
def learned_parameter_gaps(spark, sf):
    """Scaler parameters of the fitted pipeline beside plain aggregates."""
    data, fitted = _fitted(spark, sf)
    rows = split.only(data, "train")
    learned = features.learned_parameters(spark, fitted, _BLOCK)
    direct = features.scaling_parameters(rows, _BLOCK)
    rows = equiv.parameter_differences(learned, direct, ["mean", "std"])
    return tidy(rows.select("variable", "mean", "std", "mean_right", "std_right"))


@query("scale_roundtrip", SPLIT_SQL + f"""
SELECT id, {rounded('acct_bal', 'tax', digits=4)} FROM train WHERE acct_bal IS NOT NULL AND tax IS NOT NULL""")
def scale_roundtrip(spark, sf):
    """Scale and unscale two columns with learned parameters; the values must come back."""
    rows = split.only(with_split(spark, sf), "train").select("id", "acct_bal", "tax").dropna()
    p = {r["variable"]: r for r in
         features.scaling_parameters(rows, ["acct_bal", "tax"]).collect()}  # two rows
    means, stds = ([p[c][k] for c in ("acct_bal", "tax")] for k in ("mean", "std"))
    back = features.unscale(features.scale(F.array("acct_bal", "tax"), means, stds), means, stds)
    return tidy(rows.select("id", back[0].alias("acct_bal"), back[1].alias("tax")), 4)


@query("table_equivalence", BASE_SQL + ", e AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, sum({c}) AS s FROM base" for c in NUM)
    + f""") SELECT variable, n AS n_left, n AS n_right, {rounded('s AS sum_left', 's AS sum_right', digits=2)},
    true AS equal FROM e""")
def table_equivalence(spark, sf):
    """Base table through text and back against the direct route."""
    from riskweave.functions.clean import base_table
    from riskweave.plans.base import raw_orders

    raw = raw_orders(spark, sf)
    as_text = raw.select(*[F.col(c).cast("string").alias(c) if t in ("double", "bigint") else F.col(c)
                           for c, t in raw.dtypes])
    rows = equiv.table_equivalence(prepared(spark, sf), base_table(as_text, ORDERS), NUMERIC)
    return tidy(rows.drop("relative_gap"), 2)


@query("category_equivalence", BASE_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS categories, 0::BIGINT AS different FROM base"
    for c in CAT))
def category_equivalence(spark, sf):
    from riskweave.plans.base import base

    return equiv.category_equivalence(prepared(spark, sf), base(spark, sf), CATEGORICAL)


@query("balance_weights", BASE_SQL + f"""
SELECT target, count(*) AS n, {rounded('sum(CASE WHEN target = 1 THEN 0.5e0 / p ELSE 0.5e0 / (1 - p) END)'
                                      ' AS total_weight')}
FROM base, (SELECT avg(target) AS p FROM base) GROUP BY 1""")
def balance_weights(spark, sf):
    rows = train.with_balance_weights(prepared(spark, sf).select("target"), "target")
    return tidy(rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("weight").alias("total_weight")))


_NB = NUM
_NB_LOG = " + ".join(
    f"(-0.5e0 * ln(2 * pi() * (v_{c} + eps)) - ({c} - m_{c}) ** 2 / (2 * (v_{c} + eps)))" for c in _NB)


@query("naive_bayes_scores", BASE_SQL + f""", d AS (SELECT id, target, {', '.join(_NB)} FROM base
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NB)}),
e AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in _NB)}) AS eps FROM d),
k AS (SELECT target AS cls, count(*)::DOUBLE AS n, {', '.join(
    f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in _NB)} FROM d GROUP BY 1),
l AS (SELECT id, cls, ln(n / (SELECT count(*) FROM d)) + {_NB_LOG} AS ll FROM d, k, e),
p AS (SELECT id, max(ll) FILTER (cls = 1) AS l1, max(ll) FILTER (cls = 0) AS l0 FROM l GROUP BY 1)
SELECT id, {rounded('1 / (1 + exp(l0 - l1)) AS score')} FROM p""")
def naive_bayes_scores(spark, sf):
    rows = prepared(spark, sf).select("id", F.col("target").cast("double").alias("label"),
                                      *_NB).dropna()
    stages = [VectorAssembler(inputCols=_NB, outputCol="features"), NaiveBayes(modelType="gaussian")]
    fitted = Pipeline(stages=stages).fit(rows)
    return tidy(evaluate.score_rows(fitted, rows).select("id", "score"))


def ml_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Written (train with folds, test) model inputs."""
    data, fitted = _fitted(spark, sf)
    # the fold of a row is found where the row is, so no vector is shuffled
    folds = split.stratified_folds(split.only(data, "train"), 3)
    train_rows = features.model_input(fitted, folds, keep=["fold"])
    test_rows = features.model_input(fitted, split.only(data, "test"))
    return materialise(train_rows, "ml_train"), materialise(test_rows, "ml_test")


_ML: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def ml_input(spark, sf) -> tuple[DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ML:
        _ML[key] = ml_tables(spark, sf)
    return _ML[key]


#: Grid points fitted at the same time; the fits of small tables leave most tasks idle.
_PARALLEL = 8
_MODELS = ["LogisticRegression", "DecisionTree", "ProbabilityTree", "RandomForest",
           "ProbabilityForest", "GradientBoosting", "LinearSVC", "NaiveBayes"]


def tuned(spark, sf, name: str) -> tuple[train.Tuned, DataFrame, DataFrame]:
    """The whole grid of a model, searched once for the same training rows."""
    train_rows, test_rows = ml_input(spark, sf)
    candidate = train.candidates(train_rows.first()["features"].size)[name]
    found = train.tune_stored(f"{scratch_folder(spark)}/fits", name, candidate, train_rows,
                              fold_col="fold", parallelism=_PARALLEL)
    return found, train_rows, test_rows


def fit_record(spark, sf, name: str) -> DataFrame:
    """Best point, cost of the search, iterations, cross-validated, train and test AUC, threshold
    learned on train, and test metrics at it and at the default threshold."""
    result, train_rows, test_rows = tuned(spark, sf, name)
    tag = {"pipeline": F.lit("spark"), "model": F.lit(name)}
    seconds, spent = {"search": result.seconds}, time.perf_counter()

    def timed(step: str, df: DataFrame) -> DataFrame:
        nonlocal spent
        made = materialise(df, step)
        now = time.perf_counter()
        seconds[step], spent = now - spent, now
        return made

    on_test = timed("prediction", result.scores(test_rows).withColumns(tag))
    on_train = materialise(result.scores(train_rows).withColumns(tag), "scores")
    found = timed("threshold", evaluate.youden_threshold(on_train))
    table_ = timed("evaluation", evaluate.metric_table(
        on_test, found, default=train.default_threshold(result.column)))
    keys = evaluate.KEYS
    auc_train = evaluate.auc(on_train).withColumnRenamed("auc", "auc_train")
    best = result.grid.orderBy(F.desc("mean_auc"), F.asc("point")).limit(1).select(
        "model", "params", F.col("mean_auc").alias("auc_cv"))
    rows = table_.join(auc_train, keys).join(found.select(*keys, "youden"), keys).join(best, "model")
    return rows.withColumns({
        "overfit_gap": F.col("auc_train") - F.col("auc"),
        "points": F.lit(result.grid.count()), "fits": F.lit(result.fits),
        "iterations": F.lit(result.iterations).cast("int"),
        **{f"seconds_{k}": F.lit(v) for k, v in seconds.items()}})


for _name in _MODELS:
    query(f"tuned_{_name.lower()}")(lambda spark, sf, name=_name: fit_record(spark, sf, name))


@query("cv_grid")
def cv_grid(spark, sf):
    """Grid points with mean and spread of the fold AUCs and their rank."""
    from riskweave.operators.ranks import competition_rank

    result, _, _ = tuned(spark, sf, "LogisticRegression")
    return competition_rank(result.grid, ["model"], F.desc("mean_auc"))


@query("cv_inside_pipeline")
def cv_inside_pipeline(spark, sf):
    """The same search with the feature pipeline of every training part inside the folds."""
    rows = split.only(with_split(spark, sf), "train").withColumn("label", F.col("target") + 0.0)
    rows = materialise(split.stratified_folds(rows, 3), "raw_folds")
    pipelines = features.fold_pipelines(rows, ORDERS, "fold", 3)
    candidate = train.candidates(8)["LogisticRegression"]
    return train.tune("LogisticRegression", candidate, rows, fold_col="fold",
                      parallelism=_PARALLEL, pipelines=pipelines).grid


@query("random_folds_cv")
def random_folds_cv(spark, sf):
    """The same search with unstratified random folds."""
    train_rows, _ = ml_input(spark, sf)
    candidate = train.candidates(8)["LogisticRegression"]
    return train.tune("LogisticRegression", candidate, train_rows).grid


@query("model_inspection")
def model_inspection(spark, sf):
    """Tree sizes and linear weights of plain and balanced fits."""
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC

    train_rows, _ = ml_input(spark, sf)
    weighted = train.with_balance_weights(train_rows).persist()
    rows = []
    for name, est in (
            ("tree", DecisionTreeClassifier(maxDepth=5, seed=train.SEED)),
            ("svc", LinearSVC(standardization=False, regParam=1e-5, maxIter=100)),
            ("svc balanced", LinearSVC(standardization=False, regParam=1e-5, maxIter=100,
                                       weightCol="weight"))):
        seen = train.inspect_model(est.fit(weighted))
        rows += [(name, k, float(v)) for k, v in seen.items() if v is not None]
    weighted.unpersist()
    return spark.createDataFrame(rows, "model string, measure string, value double")


@query("hinge_objective")
def hinge_objective(spark, sf):
    """Objective of the fitted linear machine against the trivial solution."""
    from pyspark.ml.classification import LinearSVC

    train_rows, _ = ml_input(spark, sf)
    model = LinearSVC(standardization=False, regParam=1e-5, maxIter=100).fit(train_rows)
    margins = model.transform(train_rows).select(
        vector_to_array("rawPrediction")[1].alias("margin"), "label")
    return evaluate.hinge_objective(margins, "margin", "label",
                                    float(model.coefficients.norm(2)) ** 2, cost=1.0)


@query("score_store", SPLIT_SQL + """
SELECT 'spark' AS pipeline, model, count(*) AS n, sum(target)::BIGINT AS positives
FROM split, (VALUES ('lr'), ('lr2')) t(model) WHERE split = 'test' GROUP BY 2""")
def score_store_roundtrip(spark, sf):
    """Two models written to the score store, one replaced, read back with a partition filter."""
    train_rows, test_rows = ml_input(spark, sf)
    path = scratch_path(spark, "score_store")
    for name, reg in (("lr", 1e-5), ("lr2", 1e-3), ("lr", 1e-4)):
        model = LogisticRegression(regParam=reg, maxIter=100).fit(train_rows)
        score_store.write_scores(evaluate.score_rows(model, test_rows), path, "spark", name)
    return score_store.read_scores(spark, path, "spark").groupBy("pipeline", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"))


@query("model_roundtrip", SPLIT_SQL + """
SELECT count(*) AS n, 0e0 AS max_gap FROM split WHERE split = 'test'""")
def model_roundtrip(spark, sf):
    """Feature pipeline and classifier saved as one model, loaded, and compared on the test rows."""
    data = with_split(spark, sf)
    whole = features.build_pipeline(ORDERS, extra=[LogisticRegression(
        labelCol="target", maxIter=100)]).fit(split.only(data, "train"))
    path = scratch_path(spark, "model")
    tables.save_model(whole, path)
    loaded = tables.load_model(path)
    test = split.only(data, "test")
    one = evaluate.score_rows(whole, test, label="target").withColumnRenamed("score", "before")
    two = evaluate.score_rows(loaded, test, label="target").withColumnRenamed("score", "after")
    return one.join(two.drop("label"), "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max(F.abs(F.col("before") - F.col("after"))), 9).alias("max_gap"))


@query("model_comparison")
def model_comparison(spark, sf):
    """Paired tests between two fitted models on the test rows."""
    train_rows, test_rows = ml_input(spark, sf)
    wide = None
    for name, model in (
            ("lr", LogisticRegression(regParam=1e-5, maxIter=100).fit(train_rows)),
            ("nb", NaiveBayes(modelType="gaussian").fit(train_rows))):
        scored = evaluate.score_rows(model, test_rows).withColumnRenamed("score", name)
        wide = scored if wide is None else wide.join(scored.drop("label"), "id")
    wide = materialise(wide, "wide")
    return compare.delong_pairs(compare.auc_covariance(wide, ["lr", "nb"]))


def _explainable(spark, sf):
    """A fitted pipeline with classifier, its train rows and a few badly scored test rows."""
    data, fitted = _fitted(spark, sf)
    rows = split.only(data, "train")
    whole = PipelineModel([*fitted.stages, LogisticRegression(
        labelCol="target", maxIter=100).fit(fitted.transform(rows))])
    test = split.only(data, "test")
    scored = evaluate.score_rows(whole, test, label="target")
    worst = scored.select("id", F.abs(F.col("score") - F.col("label")).alias("miss")).orderBy(
        F.desc("miss"), F.asc("id")).limit(4)
    return whole, rows, test.join(worst.select("id"), "id", "left_semi")


@query("lime_batch")
def lime_batch(spark, sf):
    whole, rows, instances = _explainable(spark, sf)
    return explain.lime_batch(instances, whole, rows, NUMERIC, [*FLAGS, *CATEGORICAL],
                              samples=5000)


@query("lime_stability")
def lime_stability(spark, sf):
    whole, rows, instances = _explainable(spark, sf)
    seeds = [0, 1, 2, 3, 4]
    runs = explain.lime_batch(instances, whole, rows, NUMERIC, [*FLAGS, *CATEGORICAL],
                              samples=5000, seeds=seeds)
    return explain.condition_stability(runs, len(seeds))


@query("explanation_chain")
def explanation_chain(spark, sf):
    """The clearest false negative and false positive of two fitted models, explained by both: each
    condition with its weight in either explanation, and the overlap of the two."""
    data, pipeline = _fitted(spark, sf)
    rows, test = split.only(data, "train"), split.only(data, "test")
    # both models take the same features, which are made and written once
    train_rows, test_rows = ml_input(spark, sf)
    classifiers = {"lr": LogisticRegression(maxIter=100), "nb": NaiveBayes(modelType="gaussian")}
    fitted, limits, wide = {}, {}, test_rows
    for name, classifier in classifiers.items():
        model = classifier.fit(train_rows)
        fitted[name] = PipelineModel([*pipeline.stages, model])
        on_train = materialise(evaluate.score_rows(model, train_rows).withColumns(
            {"pipeline": F.lit("spark"), "model": F.lit(name)}), "scores")
        limits[name] = evaluate.youden_threshold(on_train).first()["threshold"]  # one row
        # one score beside the other: no join
        wide = model.transform(wide).withColumn(
            name, vector_to_array("probability")[1]).select("id", "label", "features", *limits)
    wide = wide.select("id", F.col("label").cast("int").alias("label"), *fitted)
    thresholds = F.create_map(*[x for n, v in limits.items() for x in (F.lit(n), F.lit(v))])
    cases = explain.clearest_cases(explain.hard_cases(materialise(wide, "wide"), "lr", "nb",
                                                      thresholds))
    chosen = materialise(test.join(cases.select("id"), "id", "left_semi"), "cases")  # two rows
    made = materialise(explain.lime_models(
        chosen, {n: (m, "probability") for n, m in fitted.items()}, rows, NUMERIC,
        [*FLAGS, *CATEGORICAL]), "explanations")
    aligned = explain.compare_explanations(*[made.where(F.col("model") == n) for n in fitted])
    return aligned.join(explain.explanation_overlap(aligned), "id").join(
        cases.select("id", "kind"), "id")


_REF = NUM


@query("reference_summary", SPLIT_SQL + ", q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,"
    f" quantile_cont({c}, 0.75) AS q3 FROM train" for c in _REF) + "), v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value FROM train WHERE {c} IS NOT NULL" for c in _REF) + f"""),
b AS (SELECT variable, (q1 < value)::INTEGER + (q2 < value AND q2 > q1)::INTEGER
  + (q3 < value AND q3 > q2)::INTEGER AS bin, value
  FROM v JOIN q USING (variable))
SELECT variable, bin, NULL::VARCHAR AS level, count(*) AS n, {rounded('avg(value) AS mean',
  'stddev_pop(value) AS sd', 'min(value) AS lo', 'max(value) AS hi')} FROM b GROUP BY 1, 2
""" + "".join(
    f"UNION ALL SELECT '{c}', NULL, {c}, count(*), NULL, NULL, NULL, NULL FROM train GROUP BY 3 "
    for c in CAT))
def reference_summary(spark, sf):
    rows = explain.reference_summary(split.only(with_split(spark, sf), "train"), _REF, CATEGORICAL)
    return tidy(rows.drop("cuts"))


@query("max_bins_variants")
def max_bins_variants(spark, sf):
    train_rows, test_rows = ml_input(spark, sf)
    return experiments.bin_variants(train_rows, test_rows)


@query("pruning_variants")
def pruning_variants(spark, sf):
    train_rows, test_rows = ml_input(spark, sf)
    return experiments.pruning_variants(train_rows, test_rows)


@query("pending_fits", """
WITH k AS (SELECT DISTINCT p_type AS model, p_size AS grid FROM part)
SELECT model, grid FROM k WHERE (model, grid) NOT IN (SELECT p_type, p_size FROM part WHERE p_partkey % 2 = 0)""")
def pending_fits(spark, sf):
    """Requested (model, grid point) pairs without a stored result."""
    part = table(spark, sf, "part")
    requested = part.select(F.col("p_type").alias("model"), F.col("p_size").alias("grid")).distinct()
    done = part.filter(F.col("p_partkey") % 2 == 0).select(F.col("p_type").alias("model"),
                                                          F.col("p_size").alias("grid"))
    return train.pending(requested, done, ["model", "grid"])
