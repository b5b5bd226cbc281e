"""Intermediate tables in the folder that the cluster shares.

A session's tables lie in one folder, named by the application; forgotten() deletes single tables as soon
as nothing reads them any more, drop_tables() all of a session's once its results have been taken.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATH = "_palimpsest_path"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and driver and executors are one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that run in it have a session's setting at value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Queries in it drop their shuffle files as they end; otherwise those stay until the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, by: str | None = None, **options: object) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: its lineage ends here, and a lost executor costs no recomputation.

    by: a column of few values whose rows lie in folders of their own; options: the Parquet writer's.
    """
    spark, path = df.sparkSession, f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def narrowed(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a written table, which can still be forgotten."""
    out = table.select(*columns)
    setattr(out, _PATH, getattr(table, _PATH, None))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of ended jobs, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forgotten(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more, and the shuffle files of ended jobs."""
    for df in tables:
        if path := getattr(df, _PATH, None):
            _delete(df.sparkSession, path)
    for df in tables:
        if df is not None:
            return swept(df.sparkSession)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the session; DataFrames that read them can't be evaluated afterwards."""
    _delete(spark, tables_dir(spark))
