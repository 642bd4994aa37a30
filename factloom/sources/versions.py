"""Tables that change together: each version is a folder of its own, and counts once a manifest names it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def published(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, path) of the version that counts, or None where there is none yet."""
    try:
        last = spark.read.schema("version long, path string").parquet(f"{folder}/manifest").orderBy("version", ascending=False).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (last["version"], last["path"]) if last else None


def load(spark: SparkSession, path: str | None, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a version; empty ones where there is none."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") if path else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def stored(tables: dict[str, DataFrame], folder: str, name: str) -> str:
    """Writes tables to a new folder, which nobody reads before publish(); its path. What a failed job left there harms nothing."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{table}")
    return path


def publish(spark: SparkSession, folder: str, version: int, path: str) -> bool:
    """Makes a stored version the one that counts, unless one of its number or a later one does: a repeated batch changes nothing.

    The manifest grows by one file of one row, which Spark's committer renames into place: all of a version counts, or nothing.
    """
    last = published(spark, folder)
    if last is not None and last[0] >= version:
        return False
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return True


#: Spark's own setting: a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of scratch(), the innermost last.
_open: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine without it, one of our own."""
    told, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        if not told and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="factloom-"))
    return (told or context.getCheckpointDir()).rstrip("/")


def kept(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """df as a compressed table under a path, in a folder for each value of `by`, read again. Its shuffle files go once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by or [])
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table that several steps read: kept in the shared folder, or in that of scratch()."""
    return kept(df, f"{_open[-1] if _open else shared(df.sparkSession)}/{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed within goes at the end, with a folder that nobody else knows; results must be kept elsewhere."""
    _open.append(f"{shared(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_open.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
