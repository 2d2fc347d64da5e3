"""Counts of items by day, domain and source, kept up to date as items change.

A change is what items were and what they are: the counts of the former are taken off, those of the latter added, for the days that they fall on only. What a
dashboard shows of days and sources comes from the rollup alone, whose size is that of its days and sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..storage import has_files, remove, stored

KEYS = ("day", "domain", "source_id")
COUNTS = ("n", "high_value", "errors")


def rollup(items: DataFrame) -> DataFrame:
    """(day, domain, source_id, n, high_value, errors) of items; those that were never fetched are left out."""
    rows = items.filter("fetched_at IS NOT NULL").groupBy(F.to_date("fetched_at").alias("day"), "domain", "source_id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("insight_score") >= scores.HIGH_VALUE).alias("high_value"), F.count_if(F.col("stage1_error").isNotNull()).alias("errors"))


def change(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """What a change of items (as they were, None for nothing, and as they are) adds to each count."""
    parts = rollup(new)
    if old is not None:
        parts = parts.unionByName(rollup(old).withColumns({c: -F.col(c) for c in COUNTS}))
    found = parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS))
    return found.filter(" OR ".join(f"{c} <> 0" for c in COUNTS))


def apply_change(spark: SparkSession, path: str, delta: DataFrame) -> int:
    """Add a change to the rollup below ``path``; only the folders of its days are read and written. Returns the number of days.

    One writer is assumed. A change is applied once: where a stream repeats a batch, old and new items are equal then, and the change is empty.
    """
    delta = stored(delta, "change")
    days = [r[0] for r in delta.select(F.col("day").cast("string")).distinct().collect()]  # of one change
    if days:
        rows = delta
        if has_files(spark, path):
            rows = rows.unionByName(read_rollup(spark, path).filter(F.col("day").cast("string").isin(days)).select(*delta.columns))
        sums = stored(rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS)).filter("n <> 0 OR high_value <> 0 OR errors <> 0"), "sums")
        # A day of which nothing is left keeps a row of zeros, so that its folder is replaced too.
        empty = delta.select("day").distinct().join(sums.select("day").distinct(), "day", "left_anti").select("day", *(F.lit(None).cast("string").alias(c) for c in KEYS[1:]), *(F.lit(0).cast("long").alias(c) for c in COUNTS))
        sums.select(*KEYS, *COUNTS).unionByName(empty).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        remove(sums)
    remove(delta)
    return len(days)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"domain string, source_id string, {', '.join(f'{c} long' for c in COUNTS)}, day date").parquet(path)


def day_view(counts: DataFrame, day: str) -> DataFrame:
    """As ``stats.day_rollup``: by domain the day's items, high-value items and errors, and the change since the day before."""
    today, before = F.col("day") == F.lit(day).cast("date"), F.col("day") == F.date_sub(F.lit(day).cast("date"), 1)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    rows = counts.filter((today | before) & F.col("domain").isNotNull()).groupBy("domain")
    return rows.agg(*(total(c, today).alias(c) for c in COUNTS), (total("n", today) - total("n", before)).alias("delta"))


def source_series(counts: DataFrame, day: str, days: int = 14) -> DataFrame:
    """(source_id, today, spark): each source's count of the day and after, and its counts of the last ``days`` days, zeros filled in."""
    last = F.lit(day).cast("date")
    recent = counts.filter((F.col("day") >= F.date_sub(last, days - 1)) & F.col("source_id").isNotNull())
    by_day = recent.groupBy("source_id", "day").agg(F.sum("n").alias("n")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("by_day"), F.sum(F.when(F.col("day") >= last, F.col("n"))).alias("today"))
    series = F.transform(F.sequence(F.date_sub(last, days - 1), last), lambda d: F.coalesce(F.try_element_at("by_day", d), F.lit(0)))
    return by_day.select("source_id", F.coalesce("today", F.lit(0)).alias("today"), series.alias("spark"))
