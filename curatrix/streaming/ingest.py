"""Incremental ingest: landed raw items merge into the items table, file by file, with the result of the batch merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import normalize, not_before
from ..sources.items_table import ItemsTable

RAW = T.StructType([T.StructField("batch_id", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("source_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("canonical_url", T.StringType()), T.StructField("content_text", T.StringType()), T.StructField("native_id", T.StringType()), T.StructField("author", T.StringType()), T.StructField("published_at", T.TimestampNTZType()), T.StructField("fetched_at", T.TimestampNTZType())])


def ingest_stream(spark: SparkSession, landed: str, items: str, checkpoint: str, sources: DataFrame, now: str, since: str | None = None, files_per_batch: int = 1, buckets: int = 64) -> list[dict[str, int]]:
    """Merge all files landed so far and stop; returns the tallies of each batch that ran. Future items are rejected and those before ``since``
    dropped as plain filters; state is the items table.

    The table lies in layers of buckets (sources.items_table): a batch is shuffled, what is stored is not, and appends a layer. A batch that ran before a
    crash is known by its number and is not merged again.
    """
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
    if since:
        stream = stream.filter(not_before(F.col("published_at"), since))
    table, told = ItemsTable(spark, items, buckets), []

    def merge(batch: DataFrame, number: int) -> None:
        told.append(table.merge(normalize(batch, sources, now), token=f"{checkpoint}#{number}"))

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return told


def read_items(spark: SparkSession, items: str) -> DataFrame | None:
    """The items table that streams merge into; None before the first batch."""
    return ItemsTable(spark, items).read()
