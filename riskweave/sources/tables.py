"""Parquet intermediates, result tables and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables (one row per model, grid point or test) as CSV or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scan_layout(df: DataFrame) -> dict:
    """Rows, partitions and storage level of a scan."""
    level = df.storageLevel
    return {"rows": df.count(), "partitions": df.rdd.getNumPartitions(),
            "in_memory": level.useMemory, "on_disk": level.useDisk}
