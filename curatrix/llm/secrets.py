"""Secret scans with corpus-wide ownership.

One pass over the texts finds candidates: the base kinds, which always stay, and long mixed tokens. The
hash of each candidate's value is then counted over the corpus by distinct repositories and distinct owners.
A value that several owners have, or many repositories whoever owns them, is a widely copied example; one
that stays with few owners in few repositories is live-looking. Live-looking mixed tokens are the spans that
the method adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, stage, table, texts

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "mixed")
#: A value with as many distinct owners, or as many distinct repositories, is a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6

_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), sorted: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = []
    if _WORDS.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def mixed_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with lower and upper case letters and digits that no base span touches."""
    out = []
    for m in MIXED.finditer(text):
        v = m[0]
        if any(c.islower() for c in v) and any(c.isupper() for c in v) and any(c.isdigit() for c in v) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        ids, counts, shas, spans = [], [], [], []
        for text in texts(batch, "text"):
            base = base_spans(text)
            ids.append(row)
            row += 1
            counts.append([sum(s[1] == k for s in base) for k in range(3)])
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).digest()[:16]} for a, k, b, v in sorted(base + mixed_spans(text, base))])
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(batch.column(c) for c in names), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(shas), pa.array(spans, _SPANS)], names=["row", *names, "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def ownership(each: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """value, owners, repositories and live for each distinct value of (value, repo, owner).

    Triples are made distinct before anything gathers, so that a value which stands everywhere arrives once a repository.
    """
    held = each.select("value", "repo", "owner").distinct()
    owned = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repositories"))
    return owned.withColumn("live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row the base counts and digest, all spans, how many candidates look live or like examples, and the most owners and
    repositories that one of its candidates has in the corpus (0 without candidates).

    Null and empty texts have no spans. Null repositories and owners count as one repository and owner; a repository is
    told apart by its own name only, so the caller's column should name its owner too. Repeated rows each keep a row and
    count as one owner. An empty table gives no rows. Texts of any length are scanned whole; a text and its spans are held
    by one task. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stage(rows.mapInArrow(_scan, f"row long, doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,value:binary>>"), "secrets")
    each = found.select("row", "repo", "owner", F.explode("found").alias("s")).select("row", "repo", "owner", "s.*")
    told = each.join(ownership(each, example_owners, example_repositories).withColumnRenamed("value", "of_value"), F.col("value") == F.col("of_value"))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    shown = F.struct("start", "kind", F.concat_ws(":", names, F.col("start"), F.col("end")).alias("text"))
    kept = F.when((F.col("kind") < 3) | F.col("live"), shown)
    figures = {"n_live": F.count_if("live"), "n_examples": F.count_if(~F.col("live")), "most_owners": F.max("owners"), "most_repositories": F.max("repositories")}
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["text"]), ",")
    by_row = told.groupBy("row").agg(spans.alias("spans"), *(f.alias(n) for n, f in figures.items())).withColumnRenamed("row", "of_row")
    out = found.drop("found", "repo", "owner").join(by_row, F.col("row") == F.col("of_row"), "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *(F.coalesce(n, F.lit(0)).alias(n) for n in figures))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """A source is the owner, its texts of one language a repository."""
    docs = spread(table(spark, sf_dir, "documents"))
    return scan_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
