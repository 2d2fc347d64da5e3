"""Items placed by the day on which they expire, so that retention drops folders and reads no item."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_folder, has_files, qualified, rename, subfolders

DAY, NEVER = "expires_on", "never"


def write_by_expiry(items: DataFrame, path: str, mode: str = "append") -> None:
    """Items below ``path`` in a folder for each day on which some expire; those that never do have a folder of their own."""
    day = F.coalesce(F.to_date("expires_at").cast("string"), F.lit(NEVER))
    items.withColumn(DAY, day).write.mode(mode).partitionBy(DAY).option("compression", "zstd").parquet(path)


def read_by_expiry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).drop(DAY)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder, rows) of Parquet files, from their footers."""
    for batch in batches:
        folders, rows = [], []
        for uri in batch.column("file").to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                rows.append(pq.read_metadata(file).num_rows)
            folders.append(uri.rsplit("/", 2)[-2])
        yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(rows, pa.int64())], names=["folder", "rows"])


def counted(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(folder, rows) of folders of Parquet files: listed, and counted by the files' footers; no data is read."""
    shape = "folder string, rows long"
    if not folders:
        return spark.createDataFrame([], shape)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"))
    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_footers, shape).groupBy("folder").agg(F.sum("rows").alias("rows"))


def drop_expired(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """Delete the items that expire before ``cutoff``; (day, deleted) of each day that lost some.

    Folders of days before the cutoff's go as they are, counted by their files' footers. Only where the cutoff falls within a day is that day's
    folder written anew, without what has expired by then. A run that was broken off is simply run again. Readers of
    what is dropped must have ended.
    """
    path = qualified(spark, path)
    last, clock = cutoff[:10], cutoff[11:]
    days = sorted(f.removeprefix(f"{DAY}=") for f in subfolders(spark, path) if f.startswith(f"{DAY}=") and f != f"{DAY}={NEVER}")
    gone = [d for d in days if d < last]
    told = [(r.folder.removeprefix(f"{DAY}="), r.rows) for r in counted(spark, [f"{path}/{DAY}={d}" for d in gone]).collect()]  # a row a day
    for day in gone:
        drop_folder(spark, f"{path}/{DAY}={day}")
    if last in days and clock.strip("0:.") and has_files(spark, f"{path}/{DAY}={last}"):
        folder, fresh = f"{path}/{DAY}={last}", f"{path}/_fresh-{last}"
        rows = spark.read.parquet(folder)
        stays = F.col("expires_at") >= F.lit(cutoff).cast("timestamp_ntz")
        if n := rows.filter(~stays).count():
            told.append((last, n))
            drop_folder(spark, fresh)
            rows.filter(stays).write.option("compression", "zstd").parquet(fresh)
            drop_folder(spark, folder)
            rename(spark, fresh, folder)
    return spark.createDataFrame(sorted(told), "day string, deleted long")
