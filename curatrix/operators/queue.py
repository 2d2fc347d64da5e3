"""The queue of deep reports: selection, enqueueing, claims and results. Each step returns the queue's next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import extract_arxiv, extract_ghsa


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def candidates(items: DataFrame, floor: int, limit: int = 20, order: str = "doc_id") -> DataFrame:
    """The best security items that name an advisory, no score counting as 0; ``limit`` is the run's allowance."""
    subject = extract_ghsa(F.col("canonical_url"), F.col("id"), F.col("advisory_text"))
    found = items.filter("domain = 'security'").withColumn("subject", subject).filter(F.col("subject").isNotNull() & (F.coalesce("insight_score", F.lit(0)) >= floor))
    return found.orderBy(F.coalesce("insight_score", F.lit(0)).desc(), order).limit(limit).select("subject", F.col("id").alias("item_id"), "insight_score", order)


def papers(items: DataFrame) -> DataFrame:
    subject = extract_arxiv(F.col("canonical_url"), F.col("id"))
    return items.withColumn("subject", subject).filter("subject IS NOT NULL").select("subject", F.col("id").alias("item_id"))


def enqueue(queue: DataFrame, wanted: DataFrame, now: str, order: str = "doc_id") -> DataFrame:
    """New subjects are queued, failed ones queued again with the new item; subjects with any other row stay. Of several wants of one subject the last counts."""
    last = wanted.groupBy("subject").agg(F.max_by("item_id", order).alias("new_item"))
    both = queue.join(last, "subject", "full_outer")
    fresh, again = F.col("status").isNull(), (F.col("status") == "failed") & F.col("new_item").isNotNull()
    return both.select("subject", F.when(fresh | again, F.col("new_item")).otherwise(F.col("item_id")).alias("item_id"), F.when(fresh | again, "queued").otherwise(F.col("status")).alias("status"),
                       "claimed_at", "worker_id", F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), F.coalesce("created_at", _at(now)).alias("created_at"))


def reset_stale(queue: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """Rows claimed longer ago fail and lose their claim."""
    old = (F.col("status") == "running") & (F.col("claimed_at") < _at(now) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    old = F.coalesce(old, F.lit(False))
    return queue.withColumns({"status": F.when(old, "failed").otherwise(F.col("status")), "worker_id": F.when(~old, F.col("worker_id")), "claimed_at": F.when(~old, F.col("claimed_at"))})


def claim(queue: DataFrame, worker: str, now: str, most: int, retry_failed: bool = False) -> DataFrame:
    """The oldest waiting rows become running, with one attempt more. One writer at a time; ``most`` is the worker's batch."""
    states = ("queued", "failed") if retry_failed else ("queued",)
    taken = queue.filter(F.col("status").isin(*states)).orderBy("created_at", "subject").limit(most).select("subject", F.lit(True).alias("mine"))
    both = queue.join(taken, "subject", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    mine = F.col("mine")
    return both.withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "claimed_at": F.when(mine, _at(now)).otherwise(F.col("claimed_at")), "worker_id": F.when(mine, F.lit(worker)).otherwise(F.col("worker_id")), "attempt_count": F.col("attempt_count") + mine.cast("int")}).drop("mine")


def finalise(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running rows with an outcome (subject, outcome: ok, empty, not_qualified or failed) take it and lose their claim."""
    both = queue.join(outcomes, "subject", "left")
    done = F.coalesce((F.col("status") == "running") & F.col("outcome").isNotNull(), F.lit(False))
    return both.withColumns({"status": F.when(done, F.col("outcome")).otherwise(F.col("status")), "worker_id": F.when(~done, F.col("worker_id")), "claimed_at": F.when(~done, F.col("claimed_at"))}).drop("outcome")


def pending(names: DataFrame, stored: DataFrame) -> DataFrame:
    """Report files whose stem is not a stored subject."""
    return names.join(stored.select(F.col("subject").alias("stem")), "stem", "left_anti")


def upsert_reports(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports over stored rows by subject; of several the one read last (largest ``pos``) counts; all columns but the key are overwritten."""
    columns = [c for c in stored.columns if c != "subject"]
    last = reports.groupBy("subject").agg(F.max_by(F.struct(*columns), "pos").alias("new"))
    both = stored.join(last, "subject", "full_outer")
    return both.select("subject", *(F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in columns))
