"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; caller settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW_DEFAULT = "67108864b"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound its Arrow batches.

    Functions that run in Python workers are pickled by reference, so the workers must be able to
    import the package also when the driver runs outside its folder. Batches are cut at 8 MB, unless
    the session asks for another size, so that long texts do not fill a worker's memory. Shuffle files
    go when the query that wrote them ends: no later one reads them, intermediates are written tables.
    """
    spark.conf.set(_CLEANUP, "true")
    if spark.conf.get(_ARROW_BYTES) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_BYTES, "8m")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="riskweave-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as the cluster names it.

    Only a local session without the setting gets a folder of its own; a cluster without one is an
    error, because a machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="riskweave-")
    return _LOCAL_ROOTS[app]


def scratch_folder(spark: SparkSession) -> str:
    """The one folder that holds everything this application has written."""
    return f"{scratch_root(spark)}/riskweave-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete what the application has written; tables read from there are gone afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, name: str, partition_by: list[str] = ()):
    """Write once, read back: cuts the lineage with files that survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if path.getParent().getName() != scratch_folder(spark).rsplit("/", 1)[1]:
            raise ValueError(f"not a table of materialise: {path}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df):
    """A written table in at least one partition per core: a small one comes back in very few, and all
    that is fitted on it would run in as few tasks. A larger one stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
