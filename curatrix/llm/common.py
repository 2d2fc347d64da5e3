"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

#: Rows of an Arrow batch. Whole texts may be long, and the JVM and Python each hold a batch; Spark's own 10,000 rows of
#: some kB take much of an executor.
BATCH_ROWS = 1000

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows within; a smaller setting stays, and the session's own returns afterwards.

    Spark bounds the bytes of a batch itself (``arrow.maxBytesPerBatch``).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, sorted_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark):
        (df.sortWithinPartitions(*sorted_by) if sorted_by else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that lies in a single file, which one or two tasks would read, dealt over all cores; any other as it is."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if len(rows.inputFiles()) == 1 else rows


def content_key(*columns: str) -> Column:
    """128-bit key of a row's contents, the same in every run; nulls and empty texts differ."""
    shown = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x00", *shown)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column's values; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a variant of it that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Rows of a few hashes up to which a side may be broadcast (16 to 32 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows, counted, are within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
