"""Results kept under a digest of what they were made from.

The key of a result covers its parameters and a fingerprint of the input rows, so a changed row or
parameter leads to another key and nothing stale is ever read. A result is written beside its place and
renamed when it is whole; a reader sees all of it or nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's rows that does not depend on their order or partitions.

    One aggregate: the number of rows, and the sum and the exclusive or of two hashes of each row.
    """
    values = [vector_to_array(F.col(f"`{f.name}`")) if isinstance(f.dataType, VectorUDT)
              else F.col(f"`{f.name}`") for f in df.schema]
    # the hash skips nulls, so their places are hashed too
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(F.lit(1), *nulls, *values).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit(2), *nulls, *values)).alias("mixed")).first()
    return digest(df.schema.jsonValue(), row["n"], str(row["total"]), row["mixed"])


def digest(*parts) -> str:
    """Digest of values that JSON can write."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def publish(spark: SparkSession, path: str, write: Callable[[str], None],
            replace: bool = False) -> bool:
    """Let `write` fill a folder beside `path` and move it there; False if another result was first."""
    beside = f"{path}-{uuid.uuid4().hex[:12]}.part"
    files, source = _files(spark, beside)
    target = _files(spark, path)[1]
    try:
        write(beside)
        if replace and files.exists(target):
            files.delete(target, True)
        return not files.exists(target) and files.rename(source, target)
    finally:
        if files.exists(source):
            files.delete(source, True)
