"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode (tests); on a cluster there is none that
    executors share, so that it is an error."""
    global _own_folder
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_folder


def run_folder(spark: SparkSession) -> str:
    """The one folder below it that holds all intermediate tables of this application."""
    return f"{shared_folder(spark)}/curatrix-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with a scheme, as file systems other than Spark's take it."""
    system, path = _system(spark, folder)
    found = system.makeQualified(path).toString()
    return f"file:///{found.removeprefix('file:').lstrip('/')}" if found.startswith("file:") else found


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, folder: str) -> None:
    system, path = _system(spark, folder)
    system.mkdirs(path)


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds anything that Spark would read."""
    system, path = _system(spark, folder)
    return system.exists(path) and any(not f.getPath().getName().startswith(("_", ".")) for f in system.listStatus(path))


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, from its listing; none where it isn't there."""
    system, path = _system(spark, folder)
    return [f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()] if system.exists(path) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, path = _system(spark, old)
    if not system.rename(path, _system(spark, new)[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def drop_folder(spark: SparkSession, folder: str) -> None:
    system, path = _system(spark, folder)
    system.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that were made of them can't be read any more."""
    drop_folder(spark, run_folder(spark))


def remove(table: DataFrame) -> None:
    """Remove a written table of this application that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/curatrix-{spark.sparkContext.applicationId}/" in folder:
            drop_folder(spark, folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what it took to make is not done again, however often the result is used."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
