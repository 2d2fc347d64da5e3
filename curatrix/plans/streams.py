"""The streaming twin of the merge: raw items land as files, batch by batch, and are ingested as they come."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import NOW, TODAY, Tables
from ..operators.ingest import normalize
from ..registry import query
from ..storage import new_path
from ..streaming import rollups
from ..streaming.ingest import RAW, ingest_stream, read_items
from .ingest import _MERGED_ITEMS, _NORM, shown


def _land(t: Tables, folder: str) -> None:
    rows = t.raw_items.select(*(F.col(f.name).cast(f.dataType) for f in RAW.fields))
    for k in (1, 2, 3):
        rows.filter(F.col("batch_id") == k).write.mode("append").parquet(f"{folder}/landed")


@query("stream_ingest", _MERGED_ITEMS)
def stream_ingest(t: Tables):
    """Three micro-batches or more, in the order in which their files landed."""
    folder = new_path(t.spark, "stream")
    _land(t, folder)
    files = len(t.spark.read.schema(RAW).parquet(f"{folder}/landed").inputFiles())
    ingest_stream(t.spark, f"{folder}/landed", f"{folder}/items", f"{folder}/progress", t.sources, NOW, files_per_batch=max(1, files // 3), buckets=8)
    return shown(read_items(t.spark, f"{folder}/items"))


@query("stream_rejects", f"WITH {_NORM} SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n FROM h GROUP BY ALL")
def stream_rejects(t: Tables):
    """Filters need no state and no watermark: the stream appends each row's outcome, and the table is counted."""
    folder = new_path(t.spark, "stream")
    _land(t, folder)
    stream = t.spark.readStream.schema(RAW).option("maxFilesPerTrigger", 2).parquet(f"{folder}/landed")
    judged = normalize(stream, t.sources, NOW).select(F.coalesce("reject_reason", F.lit("ok")).alias("outcome"))
    run = judged.writeStream.format("parquet").option("path", f"{folder}/judged").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema("outcome string").parquet(f"{folder}/judged").groupBy("outcome").agg(F.count("*").alias("n"))


def _kept_rollup(t: Tables) -> str:
    """Items come in three changes, each with late ones of all days; then a third of them is scored anew, and some are taken away."""
    path = new_path(t.spark, "rollup")
    items = t.items.select("doc_id", "domain", "source_id", "fetched_at", "insight_score", "stage1_error")
    raw = items.withColumns({"insight_score": F.lit(99), "stage1_error": F.lit(None).cast("string")})
    for k in range(3):
        mine = F.col("doc_id") % 3 == k
        rollups.apply_change(t.spark, path, rollups.change(None, (raw if k == 1 else items).filter(mine)))
    rollups.apply_change(t.spark, path, rollups.change(raw.filter("doc_id % 3 = 1"), items.filter("doc_id % 3 = 1")))
    twice = items.filter("doc_id % 5 = 0")
    rollups.apply_change(t.spark, path, rollups.change(None, twice))
    rollups.apply_change(t.spark, path, rollups.change(twice, twice.filter("false")))
    return path


@query("rollup_day", f"""
SELECT domain, count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}') AS n, count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' AND insight_score >= 75) AS high_value,
  count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' AND stage1_error IS NOT NULL) AS errors, count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}') - count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' - 1) AS delta
FROM b_items WHERE fetched_at >= DATE '{TODAY}' - 1 AND fetched_at < DATE '{TODAY}' + 1 GROUP BY domain""")
def rollup_day(t: Tables):
    return rollups.day_view(rollups.read_rollup(t.spark, _kept_rollup(t)), TODAY)


@query("rollup_series", f"""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 13, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT source_id, CAST(fetched_at AS DATE) AS day, count(*) AS n FROM b_items WHERE fetched_at >= DATE '{TODAY}' - 13 GROUP BY ALL), s AS (SELECT DISTINCT source_id FROM c)
SELECT s.source_id, (SELECT coalesce(sum(n), 0) FROM c x WHERE x.source_id = s.source_id AND x.day >= DATE '{TODAY}')::BIGINT AS today, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY days.day) AS spark
FROM s CROSS JOIN days LEFT JOIN c ON c.source_id = s.source_id AND c.day = days.day GROUP BY s.source_id""")
def rollup_series(t: Tables):
    found = rollups.source_series(rollups.read_rollup(t.spark, _kept_rollup(t)), TODAY)
    return found.withColumn("spark", F.array_join("spark", ","))
