"""Rollups over items and sources; one pass of conditional aggregates wherever a figure allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def visible_items(items: DataFrame, sources: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Items of the domains whose source is in the catalog."""
    known = sources.select(F.col("id").alias("source_id"))
    return items.filter(F.col("domain").isin(*domains)).join(known, "source_id", "left_semi")


def _day(day: str) -> Column:
    return F.lit(day).cast("date")


def day_rollup(items: DataFrame, day: str) -> DataFrame:
    """By domain the day's items, high-value items and stage-1 errors, and the change since the day before."""
    at = F.to_date("fetched_at")
    today, before = at == _day(day), at == F.date_sub(_day(day), 1)
    window = (F.col("fetched_at") >= F.date_sub(_day(day), 1)) & (F.col("fetched_at") < F.date_add(_day(day), 1))
    return items.filter(window).groupBy("domain").agg(
        F.count_if(today).alias("n"), F.count_if(today & (F.col("insight_score") >= scores.HIGH_VALUE)).alias("high_value"),
        F.count_if(today & F.col("stage1_error").isNotNull()).alias("errors"), (F.count_if(today) - F.count_if(before)).alias("delta"))


def health_rollup(sources: DataFrame) -> DataFrame:
    return sources.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("approved", "candidate")), *(F.count_if(F.col("health") == x).alias(x) for x in ("good", "degraded", "disabled")))


def counts(items: DataFrame, column: str) -> DataFrame:
    return items.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def confidence_shares(items: DataFrame) -> DataFrame:
    total = F.nullif(F.count("confidence"), F.lit(0))
    return items.agg(*(F.round(F.count_if(F.col("confidence") == c) / total, 6).alias(c) for c in scores.CONFIDENCE_RANK))


def histogram(items: DataFrame) -> DataFrame:
    """All 20 buckets with their counts, empty ones too; items without a score are left out."""
    found = items.filter("insight_score IS NOT NULL").groupBy(scores.histogram_bucket(F.col("insight_score")).alias("bucket")).agg(F.count("*").alias("n"))
    every = items.sparkSession.range(scores.HISTOGRAM_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def retention_counts(items: DataFrame) -> DataFrame:
    return items.filter("insight_score IS NOT NULL").groupBy(scores.retention_bucket(F.col("insight_score")).alias("retention")).agg(F.count("*").alias("n"))


def retention_from_histogram(buckets: DataFrame) -> DataFrame:
    """The same counts from the histogram's buckets, whose edges the retention bounds share."""
    return buckets.filter("n > 0").groupBy(scores.retention_bucket(F.col("bucket") * scores.BUCKET_WIDTH).alias("retention")).agg(F.sum("n").alias("n"))


def retention_shares(items: DataFrame) -> DataFrame:
    """Retention counts as a share of all items, scored or not."""
    by = items.groupBy(scores.retention_bucket(F.col("insight_score")).alias("retention")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over six rows
    return by.withColumn("ratio", F.round(F.col("n") / F.nullif(total, F.lit(0)), 6)).filter("retention IS NOT NULL")


def score_cuts(items: DataFrame) -> DataFrame:
    s = F.col("insight_score")
    return items.agg(F.count_if(s >= scores.LOW).alias("kept"), F.count_if(s >= scores.HIGH_VALUE).alias("stage2"), F.count_if(F.coalesce(s, F.lit(0)) < scores.LOW).alias("dropped"))


def score_range(items: DataFrame, low: int, high: int) -> DataFrame:
    """Half open; items without a score are left out."""
    return items.filter((F.col("insight_score") >= low) & (F.col("insight_score") < high))


def item_summary(items: DataFrame, domains: tuple[str, ...] = ("security", "ai", "finance")) -> DataFrame:
    return items.agg(F.count("*").alias("total"), *(F.count_if(F.col("domain") == d).alias(d) for d in domains), F.count_if(F.col("insight_score") >= scores.HIGH_VALUE).alias("high_value"), *(F.count_if(F.col("confidence") == c).alias(c) for c in scores.CONFIDENCE_RANK))


BANDS = ("0-9", "10-29", "30-49", "50-74", "75-100")


def category_matrix(items: DataFrame) -> DataFrame:
    """Counts by category (without ``other``) and score band, and the largest count, at least 1."""
    rows = items.filter("category IS NOT NULL AND category <> 'other' AND insight_score IS NOT NULL").withColumn("band", scores.score_band(F.col("insight_score")))
    wide = rows.groupBy("category").pivot("band", list(BANDS)).agg(F.count(F.lit(1))).na.fill(0)
    wide = wide.select("category", *(F.col(f"`{b}`").alias("b" + b.replace("-", "_")) for b in BANDS))
    most = F.greatest(F.lit(1).cast("long"), *(F.max("b" + b.replace("-", "_")).over(Window.partitionBy()) for b in BANDS))  # over the categories
    return wide.withColumn("max_n", most)


def category_list(items: DataFrame, order: str) -> DataFrame:
    """Categories by count; the domain is that of the category's first item in ``order``."""
    by = items.filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.min_by("domain", order).alias("domain"))
    return by.withColumn("max_n", F.max("n").over(Window.partitionBy())).orderBy(F.desc("n"), "category")


def source_today(items: DataFrame, day: str) -> DataFrame:
    return items.filter(F.col("fetched_at") >= _day(day)).groupBy("source_id").agg(F.count("*").alias("n"))


def source_views(sources: DataFrame, items: DataFrame, day: str, days: int = 14) -> DataFrame:
    """Each source with today's count and a dense series of daily counts that ends today."""
    first = F.date_sub(_day(day), days - 1)
    recent = items.filter(F.col("fetched_at") >= first)
    by_day = recent.groupBy("source_id", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    known = by_day.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("by_day"), F.sum(F.when(F.col("day") >= _day(day), F.col("n"))).alias("today"))
    series = F.transform(F.sequence(first, _day(day)), lambda d: F.coalesce(F.try_element_at(F.col("by_day"), d), F.lit(0)))
    joined = sources.join(known, F.col("id") == F.col("source_id"), "left")
    zeros = F.array_repeat(F.lit(0).cast("long"), days)
    return joined.select(*sources.columns, F.coalesce("today", F.lit(0)).alias("today"), F.coalesce(series, zeros).alias("spark"))


def source_summary(sources: DataFrame, items: DataFrame, day: str, days: int = 14) -> DataFrame:
    """Counts by status and health, and the largest daily count of any source, at least 1."""
    window = (F.col("fetched_at") >= F.date_sub(_day(day), days - 1)) & (F.col("fetched_at") < F.date_add(_day(day), 1))
    by_day = items.filter(window).groupBy("source_id", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    most = by_day.agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.max("n"), F.lit(1))).alias("max_spark"))
    return health_rollup(sources).select("*", most.scalar().alias("max_spark"))


def retain(items: DataFrame, cutoff: str) -> DataFrame:
    """Items that stay: those that never expire or do so at the cutoff or later."""
    return items.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(cutoff).cast("timestamp_ntz")))
