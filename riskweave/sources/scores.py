"""Score store: long (pipeline, model, id, label, score), one folder per (pipeline, model)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("pipeline", T.StringType()),
    T.StructField("model", T.StringType())])


def _stored(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_scores(spark: SparkSession, path: str, pipeline: str | None = None,
                models: list[str] | None = None) -> DataFrame:
    """Stored scores; pipeline and model filters only open the matching folders."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if pipeline is not None:
        df = df.filter(F.col("pipeline") == pipeline)
    return df.filter(F.col("model").isin(models)) if models else df


def check_scores(new: DataFrame, stored: DataFrame | None = None) -> None:
    """Raise when a score is not finite, an observation repeats, or the observations differ."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    per_row = new.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("bad"))
    state = per_row.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
                        F.count_if(F.col("c") > 1).alias("repeated")).first()
    if state["bad"]:
        raise ValueError(f"{state['bad']} scores are not finite")
    if state["repeated"]:
        raise ValueError(f"{state['repeated']} observations appear more than once")
    if stored is not None:
        keys = ["id", "label"]
        gone = stored.select(*keys).join(new.select(*keys), keys, "left_anti")
        extra = new.select(*keys).join(stored.select(*keys), keys, "left_anti")
        n = gone.unionByName(extra).count()
        if n:
            raise ValueError(f"{n} observations differ from the stored score set")


def write_scores(scores: DataFrame, path: str, pipeline: str, model: str) -> None:
    """Add or replace one model's scores after checking them against a stored set.

    Only the folder of this (pipeline, model) is overwritten.
    """
    spark = scores.sparkSession
    rows = scores.select("id", F.col("label").cast("int").alias("label"), "score")
    stored = None
    if _stored(spark, path):
        others = read_scores(spark, path, pipeline)
        # any one model of the pipeline serves as the reference set
        name = others.agg(F.min("model").alias("m")).first()["m"]
        stored = others.filter(F.col("model") == name) if name is not None else None
    check_scores(rows, stored)
    (rows.withColumns({"pipeline": F.lit(pipeline), "model": F.lit(model)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("pipeline", "model").parquet(path))
