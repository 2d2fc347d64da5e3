"""Two-stage scoring as a batch job: requests, a scorer, contracts and their application to the items table."""

from __future__ import annotations

import itertools
import re
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, scores
from ..storage import has_files, make_folder, new_path, qualified, remove, stored

STAGE2_FROM = 75
#: What an outcome says of the model that gave it.
PROVENANCE = ("model", "provider", "prompt_version")


def _payload(*fields: str | Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload")


def _with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    known = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("authority").alias("source_authority"))
    return items.join(known, "source_id", "left")


def stage1_requests(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, payload, truncated): what a model reads of each item first, its facts, its source and its content, cut in the middle."""
    content = contracts.prepare_content(F.col("content_text"))
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = _payload("title", "canonical_url", "source_name", "source_authority", at.alias("published_at"), content["text"].alias("content_text"), content["truncated"].alias("content_truncated"))
    return _with_source(items, sources).select("id", body, content["truncated"].alias("truncated"))


def stage2_requests(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, payload): what stage 1 said of each item and where else it was seen (columns tags and also_seen_in are arrays)."""
    lists = [F.coalesce(F.to_json(c), F.lit("[]")) for c in ("tags", "also_seen_in")]
    body = _payload("title", "canonical_url", "category", "summary_zh", "insight_score", "credibility", "source_name", "source_authority")
    whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"tags":'), lists[0], F.lit(',"also_seen_in":'), lists[1], F.lit("}"))
    return _with_source(items, sources).select("id", whole.alias("payload"))


#: Requests that are answered together at least, and at most where they take less than SECONDS: what a lost task repeats at most. So a model's
#: answers are kept sixteen at a time, and those of a scorer that takes no time don't make a file each sixteen.
CHUNK, MOST_CHUNK, SECONDS = 16, 10_000, 1.0
LOG = "request string, prompt_version string, raw string"


def request_key(payload: Column, prompt_version: str) -> Column:
    """The key of a request: the same payload for another prompt is another request."""
    return F.sha2(F.concat(F.lit(f"{prompt_version}\0"), payload), 256)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The answers of a log, one for each request, however often it was written."""
    if not has_files(spark, log):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log).groupBy("request").agg(F.any_value("prompt_version").alias("prompt_version"), F.any_value("raw").alias("raw"))


def _answering(scorer: Callable[[str], str], folder: str, prompt_version: str, chunk: int, most: int):
    """Rows (request, payload), sorted, are answered a chunk at a time; each chunk's answers are a file before the next one begins.

    A chunk ends with ``most`` rows, or from ``chunk`` rows on when SECONDS have passed. Its file is named by its first request and
    its length, and appears as a whole. A task that runs again finds the chunks of its lost attempt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        names = (re.fullmatch(r"chunk-([0-9a-f]+)-(\d+)\.parquet", f.base_name) for f in system.get_file_info(fs.FileSelector(base)))
        done: dict[str, int] = {}
        for name in filter(None, names):
            done[name[1]] = max(int(name[2]), done.get(name[1], 0))
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("request", "payload"))))
        held: deque[tuple[str, str]] = deque()
        while held or (held := deque(itertools.islice(rows, 1))):
            if n := done.get(held[0][0], 0):
                held += itertools.islice(rows, max(0, n - len(held)))
                table = pq.read_table(f"{base}/chunk-{held[0][0]}-{n}.parquet", filesystem=system)
                if table.column("request").to_pylist() == [r for r, _ in itertools.islice(held, n)]:
                    yield from table.to_batches()
                    held = deque(itertools.islice(held, n, None))
                    continue
            asked, raw, began = [], [], time.monotonic()
            while (held or (held := deque(itertools.islice(rows, 1)))) and len(raw) < most and (len(raw) < chunk or time.monotonic() - began < SECONDS):
                request, payload = held.popleft()
                raw.append(scorer(payload))
                asked.append(request)
            table = pa.table([pa.array(asked), pa.array([prompt_version] * len(asked)), pa.array(raw, pa.string())], names=["request", "prompt_version", "raw"])
            staged = f"{base}/_{uuid.uuid4().hex}"  # Spark passes over such names
            pq.write_table(table, staged, filesystem=system)
            system.move(staged, f"{base}/chunk-{asked[0]}-{len(asked)}.parquet")
            yield from table.to_batches()

    return run


def answers(payloads: DataFrame, scorer: Callable[[str], str], concurrency: int, log: str, prompt_version: str = "", chunk: int | None = None) -> DataFrame:
    """(request, raw) for each different payload: from the log where it has the request, else from the scorer, whose answers are appended.

    The number of partitions bounds how many calls run at once. Neither a second run nor a task that was lost asks again what a finished chunk holds.
    chunk: the requests of a chunk, where they shall be just so many; else CHUNK, or what is answered in SECONDS.
    """
    spark = payloads.sparkSession
    log = qualified(spark, log)
    make_folder(spark, log)
    wanted = payloads.select(request_key(F.col("payload"), prompt_version).alias("request"), "payload")
    new = wanted.join(read_log(spark, log).select("request"), "request", "left_anti") if has_files(spark, log) else wanted
    # Written first, so that a task's rows are the same whenever it runs.
    asked = stored(new.groupBy("request").agg(F.any_value("payload").alias("payload")), "requests")
    dealt = asked.repartition(concurrency, "request").sortWithinPartitions("request")
    dealt.mapInArrow(_answering(scorer, log, prompt_version, chunk or CHUNK, chunk or MOST_CHUNK), LOG).write.format("noop").mode("overwrite").save()
    remove(asked)
    return read_log(spark, log).select("request", "raw").join(wanted.select("request"), "request", "left_semi")


def score(payloads: DataFrame, scorer: Callable[[str], str], concurrency: int, contract: Callable, key: str = "id", log: str | None = None, prompt_version: str = "") -> DataFrame:
    """(key, raw, outcome): a scorer's response to each payload, with one repair attempt where the contract breaks.

    contract: a column function from the JSON payload of a response to a struct with ``error``. log: a folder that keeps all
    answers by the hash of payload and prompt version; without one, answers are kept for this run alone. So the scorer is called once for a
    payload, and once for its repair.
    """
    log = log or new_path(payloads.sparkSession, "answers")
    payloads = stored(payloads.select(key, "payload"), "payloads")  # what makes them runs once

    def answered(asked: DataFrame) -> DataFrame:
        keyed = asked.select(key, request_key(F.col("payload"), prompt_version).alias("request"))
        raw = keyed.join(answers(asked, scorer, concurrency, log, prompt_version), "request").drop("request")
        return contracts.extract_objects(raw).withColumn("outcome", contract(F.col("payload")))

    first = stored(answered(payloads), "outcomes")
    good, bad = first.filter("outcome.error IS NULL"), first.filter("outcome.error IS NOT NULL")
    again = payloads.join(bad.select(key), key, "left_semi").withColumn("payload", F.concat(F.lit("Answer with one JSON object only.\n"), "payload"))
    return good.unionByName(answered(again)).select(key, "raw", "outcome")


def _joined(items: DataFrame, outcomes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Items with their outcome and its provenance; columns that items lack are null."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in items.columns}
    known = [F.col(c) if c in outcomes.columns else F.lit(None).cast("string").alias(c) for c in PROVENANCE]
    return items.withColumns(missing).join(outcomes.select("id", "outcome", *known), "id", "left")


def _provenance(stage: int, analyzed_at: Column) -> dict[str, Column]:
    """Set whether the outcome is good or not."""
    done = F.col("outcome").isNotNull()
    values = {"analyzed_at": analyzed_at, "error": F.col("outcome.error")} | {c: F.col(c) for c in PROVENANCE}
    return {f"stage{stage}_{c}": F.when(done, v).otherwise(F.col(f"stage{stage}_{c}")) for c, v in values.items()}


def _stage_columns(stage: int) -> dict[str, str]:
    return {f"stage{stage}_{c}": "string" for c in (*PROVENANCE, "error")} | {f"stage{stage}_analyzed_at": "timestamp_ntz"}


def apply_stage1(items: DataFrame, outcomes: DataFrame, analyzed_at: str) -> DataFrame:
    """Items (id, analysis_stage, ...) with stage-1 outcomes (id, outcome, and where known model, provider, prompt_version).

    Provenance and the error are always taken over; on success also the fields and the expiry, and the stage is 1; otherwise it is 0.
    Items without an outcome stay as they are.
    """
    o, at = F.col("outcome"), F.lit(analyzed_at).cast("timestamp_ntz")
    done, ok = o.isNotNull(), o.isNotNull() & o["error"].isNull()
    fields = {"category": "string", "tags": "array<string>", "summary_zh": "string", "insight_score": "int", "credibility": "string"}
    rows = _joined(items, outcomes, fields | {"expires_at": "timestamp_ntz"} | _stage_columns(1))
    taken = {c: F.when(ok, o[c]).otherwise(F.col(c)) for c in fields} | {"expires_at": F.when(ok, scores.expires_at(o["insight_score"], at)).otherwise(F.col("expires_at"))}
    return rows.withColumns(taken | _provenance(1, at) | {"analysis_stage": F.when(ok, 1).when(done, 0).otherwise(F.col("analysis_stage"))}).drop("outcome", *PROVENANCE)


def apply_stage2(items: DataFrame, outcomes: DataFrame, analyzed_at: str) -> DataFrame:
    """As apply_stage1: on success the fields and stage 2, on an error at least stage 1."""
    o, at = F.col("outcome"), F.lit(analyzed_at).cast("timestamp_ntz")
    done, ok = o.isNotNull(), o.isNotNull() & o["error"].isNull()
    fields = ("recommendation_reason", "confidence", "trend_signal", "action_suggestion")
    rows = _joined(items, outcomes, dict.fromkeys(fields, "string") | _stage_columns(2))
    taken = {c: F.when(ok, o[c]).otherwise(F.col(c)) for c in fields}
    return rows.withColumns(taken | _provenance(2, at) | {"analysis_stage": F.when(ok, 2).when(done, F.greatest(F.lit(1), F.col("analysis_stage"))).otherwise(F.col("analysis_stage"))}).drop("outcome", *PROVENANCE)
