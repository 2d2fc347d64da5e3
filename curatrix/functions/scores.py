"""Scores, retention and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (exclusive upper bound, bucket, days kept).
RETENTION = ((10, "delete", 0), (30, "5_days", 5), (50, "10_days", 10), (75, "30_days", 30))
PERMANENT = "permanent"
HIGH_VALUE, CANDIDATE, LOW = 75, 40, 30
CONFIDENCE_RANK = {"confirmed": 3, "firm": 2, "tentative": 1}
HISTOGRAM_BUCKETS, BUCKET_WIDTH = 20, 5


def clamp(score: Column, low: int = 0, high: int = 100) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), score)))


def histogram_bucket(score: Column) -> Column:
    """Bucket 0 to 19 of width 5; 100 lies in the last."""
    return F.floor(clamp(score, 0, 99) / BUCKET_WIDTH).cast("int")


def retention_bucket(score: Column) -> Column:
    """Retention bucket, null for an item without a score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, name, _ in RETENTION:
        out = out.when(score < bound, F.lit(name))
    return out.otherwise(F.lit(PERMANENT))


def expires_at(score: Column, analyzed_at: Column) -> Column:
    """When an item goes; null for permanent ones and those without a score."""
    out = F.when(score.isNull(), F.lit(None).cast("timestamp_ntz"))
    for bound, _, days in RETENTION:
        out = out.when(score < bound, analyzed_at + F.make_dt_interval(F.lit(days)))
    return out


def derive_confidence(authority: Column, sightings: Column) -> Column:
    """From the source's authority and the number of other sightings."""
    n, official = F.coalesce(sightings, F.lit(0)), F.coalesce(authority, F.lit("regular")) == "official"
    return F.when((official & (n >= 1)) | (n >= 2), "confirmed").when(official | (n == 1), "firm").otherwise("tentative")


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def score_band(score: Column) -> Column:
    """Five bands of the category matrix."""
    s = clamp(score)
    return F.when(s < 10, "0-9").when(s < 30, "10-29").when(s < 50, "30-49").when(s < 75, "50-74").when(s.isNotNull(), "75-100")
