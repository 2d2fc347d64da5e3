"""A layout of items for look-ups and pages.

Files are ranges of the listing's order, (score, id), with a Bloom filter of the ids in each row group. An index, a row for each file, says where a file begins
and ends and how many rows it has: a page after a cursor reads the files that its rows lie in, and a look-up the row groups whose filter
lets the id pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing

#: Items of a file.
FILE_ROWS = 500_000
#: Files that a page with filters reads first; as long as it isn't full, four times as many.
FIRST_FILES, GROWTH = 1, 4
_PLACE = "struct<falling:int,id:string>"


def _place(score: Column, item: Column) -> Column:
    """Where an item stands in the listing: by falling score, none as -1, then by id."""
    return F.struct((-F.coalesce(score, F.lit(-1))).cast("int").alias("falling"), item.alias("id"))


def write_layout(items: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Items (id, insight_score, ...) in the listing's order, and their index."""
    n = max(1, -(-items.count() // file_rows))
    order = (F.coalesce("insight_score", F.lit(-1)).desc(), F.asc("id"))
    rows = items.repartitionByRange(n, *order).sortWithinPartitions(*order)
    bloom = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": str(file_rows)}
    rows.write.mode("overwrite").options(compression="zstd", **bloom).parquet(f"{path}/items")
    stored = items.sparkSession.read.parquet(f"{path}/items")
    place = _place(F.col("insight_score"), F.col("id"))
    stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(place).alias("first"), F.max(place).alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, item_id: str) -> DataFrame:
    """The item of an id; row groups that can't hold it are passed over."""
    return spark.read.parquet(f"{path}/items").filter(F.col("id") == item_id)


def page_files(spark: SparkSession, path: str, limit: int, after: str | None = None, most: int | None = None) -> list[str]:
    """The files, in order, in which the ``limit`` + 1 items after a cursor lie; most: so many files, whatever they hold."""
    index = spark.read.parquet(f"{path}/index")
    if after:
        at = listing.parse_cursor(after)
        index = index.filter(F.col("last") > _place(F.lit(at["score"]), F.lit(at["id"])).cast(_PLACE))
    out, rows = [], 0
    for r in index.orderBy("first").select("file", "rows").limit(most or limit + 2).collect():  # each but the first holds a row at least
        if not most and rows > limit:
            break
        rows += r["rows"] if out or not after else 0  # of the first one some rows may stand before the cursor
        out.append(r.file)
    return out


def page(spark: SparkSession, path: str, limit: int, after: str | None = None, filters: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``listing.page`` over the whole table: the next ``limit`` items and one more, read from the files that they lie in.

    With filters the files are taken in growing numbers till the page is full.
    """
    whole = spark.read.parquet(f"{path}/items")
    read = lambda files: spark.read.schema(whole.schema).parquet(*files) if files else whole.filter("false")
    if filters is None:
        return listing.page(read(page_files(spark, path, limit, after)), limit, after)
    most, before = FIRST_FILES, -1
    while True:
        files = page_files(spark, path, limit, after, most)
        found = listing.page(filters(read(files)), limit, after)
        if len(files) < most or len(files) == before or found.count() > limit:
            return found
        before, most = len(files), most * GROWTH
