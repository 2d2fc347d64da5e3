"""Benchmark decontamination as a prefix-filtered set join.

Each window of an item (``window`` consecutive words, or the whole of a shorter item) is a set of word shingles. A document that contains the
window contains all its shingles, one after another. The corpus is read once: each task notes its documents' runs of
consecutive shingles that the benchmark has, with their words, if they are long enough for the shortest window (length bound), and counts all such
shingles. Ordered by these counts, the prefix that a match must share is a window's rarest shingle alone. Runs and windows are joined on it; a
candidate fixes where the window would begin, which must lie within the run (positional bound), and then all its words are
compared.

All of it is joins, on the benchmark's side as on the documents': nothing of either goes through the driver but a bit map of
the benchmark's shingles, of bounded size, that keeps tasks from noting shingles which no item has (where it lets another pass, a run is
longer than need be, and nothing else changes). Shingles travel as hashes of 64 bits; words are compared as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove
from .common import content_key, free_name, slices, small, spread, stage, table, texts
from .substring_dedup import DEPTH, WordHashes, _cells, estimated, mixed, repeated_cells, rolling

WINDOW = 13
SHINGLE = 3
#: Bits of a cell's number in the bit map: 16 cells a shingle, within these (64 MB at most).
LEAST_BITS, MOST_BITS = 16, 28
#: Shingles up to which the map is made in the driver (16 MB of hashes), and counted shingles that a task holds.
DRIVER_SHINGLES, HELD_SHINGLES = 2_000_000, 2_000_000
#: Shingles of a piece of a run; pieces overlap by a window, so that none is cut.
PIECE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Words are runs of digits, letters (A-Z lower-cased) and all characters beyond ASCII; the rest separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def shingles_of(docs: list[list[bytes]], hashes: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of a size, documents laid end to end, and the places where they start."""
    n = np.array([len(d) for d in docs], np.int64)
    flat = [w for d in docs for w in d]
    starts = np.flatnonzero(np.arange(len(flat)) + size <= np.repeat(np.cumsum(n), n))
    return (mixed(rolling(hashes(flat), size, _BASE)) + np.uint64(size))[starts], starts


def _windows(window: int):
    """(key, item, n, words, shingles) of each window of each item: the words joined by blanks, the shingles by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 64):
            keys, items, sizes, shown, grams = [], [], [], [], []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch, "text")):
                words = words_of(text)
                if not words:
                    continue
                n = min(window, len(words))
                found = shingles_of([words], hashes, min(SHINGLE, n))[0].view(np.int64)
                for i in range(len(words) - n + 1):
                    joined = b" ".join(words[i : i + n])
                    keys.append(hashlib.md5(joined).digest())
                    items.append(item)
                    sizes.append(n)
                    shown.append(joined.decode())
                    grams.append(found[i : i + n - min(SHINGLE, n) + 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(shown, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=["key", "item", "n", "words", "shingles"])

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes, each given twice, so that a map of repeated cells has them all."""
    for batch in batches:
        yield np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)


def _map_of(shingles: DataFrame) -> np.ndarray:
    """The cells of all hashes in a table of distinct ones, as ``estimated`` reads them."""
    size = shingles.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * size).bit_length()))
    if size > DRIVER_SHINGLES:
        return repeated_cells(shingles, bits, _twice)
    found = np.zeros((DEPTH, 1 << bits), bool)
    for row, cells in enumerate(_cells(shingles.toArrow().column(0).to_numpy().view(np.uint64), bits)):
        found[row, cells] = True
    return np.packbits(found, axis=1, bitorder="little")


#: Kinds of rows of the table that the corpus leaves: a document, a piece of a run, a shingle's count.
DOCUMENT, RUN, COUNT = range(3)
_COLUMNS = (("kind", pa.int32()), ("row_key", pa.binary()), ("row", pa.int64()), ("n_words", pa.int64()), ("size", pa.int32()), ("start", pa.int64()), ("words", pa.string()), ("shingles", pa.list_(pa.int64())), ("shingle", pa.int64()), ("n", pa.int64()))
_SHAPE = "kind int, row_key binary, row long, n_words long, size int, start long, words string, shingles array<long>, shingle long, n long"


def runs_of(hit: np.ndarray, starts: np.ndarray, owners: np.ndarray, least: int, overlap: int, piece: int = PIECE) -> list[tuple[int, int]]:
    """Runs of ``least`` or more hits at neighbouring places of one document, as first and end among ``starts``, in pieces that overlap."""
    places = np.flatnonzero(hit)
    if not len(places):
        return []
    breaks = np.flatnonzero((np.diff(starts[places]) != 1) | (np.diff(owners[places]) != 0) | (np.diff(places) != 1))
    firsts, ends = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)] + 1
    long = ends - firsts >= least
    return [(k, min(k + piece + overlap, z)) for a, z in zip(firsts[long].tolist(), ends[long].tolist()) for k in range(a, max(a + 1, z - overlap), piece)]


def _noted(shared, least: dict[int, int], window: int):
    """Documents, runs and counts of a task. least: by size of shingles the words of the shortest window."""

    def rows(many: int, doc_id: pa.Array, **columns) -> pa.RecordBatch:
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in _COLUMNS]
        return pa.RecordBatch.from_arrays([*arrays, doc_id], names=[*(c for c, _ in _COLUMNS), "doc_id"])

    def counts(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return rows(len(found), pa.nulls(len(found), kind), kind=[COUNT] * len(found), shingle=found.view(np.int64), n=n.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, hashes, held, kind = TaskContext.get().partitionId() << 40, WordHashes(), [], pa.null()
        for batch in slices(batches):
            docs = [words_of(t) for t in texts(batch, "text")]
            kind = batch.column("doc_id").type
            lengths = np.array([len(d) for d in docs], np.int64)
            begins = np.cumsum(lengths) - lengths
            yield rows(len(docs), batch.column("doc_id"), kind=[DOCUMENT] * len(docs), row_key=batch.column("row_key"), row=np.arange(first, first + len(docs)), n_words=lengths)
            mine, sizes, places, words, grams = [], [], [], [], []
            for size, shortest in least.items():
                shingles, starts = shingles_of(docs, hashes, size)
                hit = estimated(shared.value, shingles)
                held.append(shingles[hit])
                owners = np.searchsorted(begins + lengths, starts, side="right")
                for a, z in runs_of(hit, starts, owners, shortest - size + 1, window - size, PIECE):
                    owner = int(owners[a])
                    at = int(starts[a] - begins[owner])
                    mine.append(first + owner)
                    sizes.append(size)
                    places.append(at)
                    words.append(b" ".join(docs[owner][at : at + z - a + size - 1]).decode())
                    grams.append(shingles[a:z].view(np.int64))
            yield rows(len(mine), pa.nulls(len(mine), kind), kind=[RUN] * len(mine), row=mine, size=sizes, start=places, words=words, shingles=pa.array(grams, pa.list_(pa.int64())))
            first += len(docs)
            if sum(map(len, held)) > HELD_SHINGLES:
                yield counts(held, kind)
                held = []
        if held:
            yield counts(held, kind)

    return run


def covered(spans):
    """Words that lie in any of the spans (an array of begin and end, sorted)."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["begin"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each document.

    Null and empty texts have no words and are never contaminated; items without words are never found; a
    null item id counts as the text ``None``. Rows that agree in id and text are judged alike and each keep a
    row. An empty benchmark hits nothing; an empty document table gives no rows. Texts and items of any length are read
    whole; a text is held by one task, its runs in pieces of bounded length. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), content_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("None")).alias("item"), F.col(item_text).alias("text"))
    every = stage(items.mapInArrow(_windows(window), "key binary, item string, n int, words string, shingles array<long>"), "items")
    windows = stage(every.groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("n", "words", "shingles"))), "windows")
    # By size of shingles, SHINGLE of them at most, the shortest window.
    least = {r[0]: r[1] for r in windows.groupBy(F.least("n", F.lit(SHINGLE))).agg(F.min("n")).collect()}
    shingles = stage(windows.select("key", F.posexplode("shingles").alias("place", "shingle")), "shingles")
    known = spark.sparkContext.broadcast(_map_of(shingles.select("shingle").distinct()))
    found = stage(rows.mapInArrow(_noted(known, least, window), f"{_SHAPE}, doc_id {kind}"), "noted")

    counts = found.filter(F.col("kind") == COUNT).groupBy(F.col("shingle").alias("of_shingle")).agg(F.sum("n").alias("often"))
    ranked = shingles.join(counts, F.col("shingle") == F.col("of_shingle"), "left")
    # A window with a shingle that no document has is ruled out.
    rarest = ranked.groupBy(F.col("key").alias("of_key")).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "place", "shingle")).alias("x")).filter("x.often > 0").select("of_key", "x.place", "x.shingle")
    prefixes = stage(windows.select("key", "n", "words").join(rarest, F.col("key") == F.col("of_key")).select("key", "n", F.col("words").alias("window"), "place", F.col("shingle").alias("prefix")), "prefixes")
    remove(shingles)

    runs = found.filter(F.col("kind") == RUN).select("row", "size", "start", "words", "shingles")
    each = runs.select("row", "size", "start", F.size("shingles").alias("length"), F.posexplode("shingles").alias("at", "shingle"))
    met = each.join(small(prefixes), F.col("shingle") == F.col("prefix")).withColumn("begin", F.col("at") - F.col("place"))
    fits = met.filter((F.col("begin") >= 0) & (F.col("begin") + F.col("n") - F.col("size") + 1 <= F.col("length")))
    fits = stage(fits.select(F.col("row").alias("of_row"), F.col("size").alias("of_size"), F.col("start").alias("of_start"), "begin", "n", "key", "window"), "candidates")
    # Candidates grow with the corpus and carry their window: they meet the runs' words by shuffle, not by broadcast.
    asked = runs.drop("shingles").join(fits, (F.col("row") == F.col("of_row")) & (F.col("size") == F.col("of_size")) & (F.col("start") == F.col("of_start")))
    same = F.array_join(F.slice(F.split("words", " "), F.col("begin") + 1, F.col("n")), " ") == F.col("window")
    begin = F.col("start") + F.col("begin")
    hits = stage(asked.filter(same).select("row", begin.alias("begin"), (begin + F.col("n")).alias("end"), "key").distinct(), "hits")
    remove(fits)
    spans = hits.groupBy("row").agg(covered(F.array_sort(F.collect_set(F.struct("begin", "end")))).alias("n_hit"))
    named = hits.select("row", "key").distinct().join(every.select(F.col("key").alias("of_key"), "item").distinct(), F.col("key") == F.col("of_key")).groupBy(F.col("row").alias("named_row")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = spans.join(named, F.col("row") == F.col("named_row")).select(F.col("row").alias("of_row"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = found.filter(F.col("kind") == DOCUMENT).select("doc_id", "row_key", "row", "n_words").join(stage(told, "told"), F.col("row") == F.col("of_row"), "left")
    out = out.select("doc_id", "row_key", "n_words", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows but the contaminated ones, with all their columns."""
    key, of_key = free_name(docs, "row_key"), free_name(docs, "of_key")
    bad = stage(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("row_key").alias(of_key)).distinct(), "contaminated")
    return docs.withColumn(key, content_key(id_col, text_col)).join(bad, F.col(key) == F.col(of_key), "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("row_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (
  SELECT p.doc_id, p.i, p.k, win.item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM pos) p JOIN win ON win.k = p.k AND win.s = p.s),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""
