"""Writers. A snapshot goes to a new version folder and then a pointer moves: what is being read is never overwritten."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import make_folder, qualified, stored


def write_snapshot(table: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write the table's next version; returns its folder. The pointer is a one-row table, replaced by its own next version.

    One writer is assumed: of two at once, both versions are written and either pointer may be the later one.
    """
    version = f"v{uuid.uuid4().hex}"
    writer = table.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    spark = table.sparkSession
    order = spark.read.parquet(f"{path}/_pointer").agg(F.max("n")).first()[0] + 1 if has_snapshot(spark, path) else 1
    spark.range(1).select(F.lit(order).alias("n"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/_pointer")
    return f"{path}/{version}"


def has_snapshot(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/_pointer").agg(F.max_by("version", "n")).first()[0]
    return spark.read.parquet(f"{path}/{version}")


def _pointer(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(f"{path}/_pointer")
    return found.filter(F.col("n") == found.agg(F.max("n")).first()[0])


def write_parts(table: DataFrame, path: str, part: str) -> None:
    """Write the table's parts (values of the column ``part``) as their next versions; other parts stay what they are.

    The pointer names each part's folder, so that it is as long as there are parts. A crash before it moves changes nothing.
    """
    spark, version = table.sparkSession, f"v{uuid.uuid4().hex}"
    table.write.partitionBy(part).option("compression", "zstd").parquet(f"{path}/{version}")
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{version}").select(F.regexp_extract("_metadata.file_path", rf"/{part}=([^/]*)/", 1).alias("part")).distinct().withColumn("version", F.lit(version))
    order = 1
    if has_snapshot(spark, path):
        before = _pointer(spark, path)
        order = before.first().n + 1
        written = before.select("part", F.col("version").alias("old")).join(written, "part", "full_outer").select("part", F.coalesce("version", "old").alias("version"))
    written.select(F.lit(order).alias("n"), "part", "version").coalesce(1).write.mode("append").parquet(f"{path}/_pointer")


def read_parts(spark: SparkSession, path: str, part: str, only: list[str] | None = None) -> DataFrame | None:
    """The table, or the named parts of it, without the column ``part``; None where there are none yet."""
    if not has_snapshot(spark, path):
        return None
    folders = [f"{path}/{r.version}/{part}={r.part}" for r in _pointer(spark, path).collect() if only is None or r.part in only]
    return spark.read.parquet(*folders) if folders else None


def _writing(folder: str):
    """Rows (file, content) that come by file, each written under a passing name and then given its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        before = None
        for batch in batches:
            names, sizes = batch.column("file").to_pylist(), []
            for name, text in zip(names, batch.column("content").to_pylist()):
                if name == before:
                    raise ValueError(f"more than one text for {name}")
                before = name
                data = (text if text.endswith("\n") else f"{text}\n").encode()
                passing = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(passing) as out:
                    out.write(data)
                if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{base}/{name}")
                system.move(passing, f"{base}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return run


def write_text_files(texts: DataFrame, path: str) -> DataFrame:
    """Texts (file, content), one file each under its own name; a file that is there already is replaced. Returns (file, bytes) of what was written.

    Tasks write the files, which end in a line break; nothing of them goes through the driver. A task that runs again writes the same files. Null
    texts are empty; two texts of one name are an error, and so is a name that is no plain one.
    """
    spark, folder = texts.sparkSession, qualified(texts.sparkSession, path)
    make_folder(spark, folder)
    plain = F.col("file").rlike(r"^[^/\\_.][^/\\]*$")
    named = F.when(plain, F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no plain file name: "), F.coalesce("file", F.lit("null")))).cast("string"))
    rows = texts.select(named.alias("file"), F.coalesce("content", F.lit("")).alias("content"))
    return stored(rows.repartition("file").sortWithinPartitions("file").mapInArrow(_writing(folder), "file string, bytes long"), "written")


def write_digests(digests: DataFrame, path: str) -> None:
    """Digests by day and domain; a day and domain that is written again replaces its own partition only."""
    digests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "domain").parquet(path)


def digest_job(digests: DataFrame, path: str, upload: Callable[[DataFrame], DataFrame] | None = None, prefix: str = "digests", base_url: str = "", posts: str | None = None) -> DataFrame:
    """Write the digests, as files under their names too where a folder of posts is given, hand them to an optional uploader, and
    return each one's file, backup key and URL."""
    write_digests(digests, path)
    if posts:
        write_text_files(digests.select("file", "content"), posts)
    placed = digests.select("day", "domain", "file", F.concat(F.lit(f"{prefix}/"), F.col("day").cast("string"), F.lit("/"), "domain", F.lit(".md")).alias("backup_key"))
    placed = placed.withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/"), "backup_key"))
    return upload(placed) if upload else placed


def append_attempts(attempts: DataFrame, path: str) -> None:
    """The fetch log: seconds to three places."""
    attempts.withColumn("duration_s", F.round("duration_s", 3)).write.mode("append").parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
