"""Messy text files: every column is read as text and typed afterwards in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskweave.functions.clean import base_table
from riskweave.spec import FeatureSpec


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """CSV with header, quoted multi-line fields and doubled quotes; gzip is recognised by name.

    With ``columns`` (the file's column names in order) no extra pass over the header is made.
    Nothing is inferred: inference would read the whole file a second time. A compressed or
    multi-line file is read by one task, so large inputs should be many files, or be converted to
    Parquet once. ``keep`` selects columns; the parser skips the others.
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"'))
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*keep) if keep else df


def read_base(spark: SparkSession, path: str, spec: FeatureSpec) -> DataFrame:
    """Text file straight to the typed base table of a spec."""
    return base_table(read_text_csv(spark, path), spec)


def write_text_csv(df: DataFrame, path: str, compress: bool = True) -> None:
    writer = (df.write.mode("overwrite").option("header", True).option("quote", '"')
              .option("escape", '"').option("lineSep", "\n"))
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
