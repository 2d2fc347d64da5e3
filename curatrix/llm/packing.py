"""Packing by shortest-pack-first over the length histogram.

Documents are cut into whole windows and a rest. Only the histogram of lengths (at most ``window``
bins, whatever the corpus) goes to the driver, which places lengths longest first into the shortest
pack that holds them, a whole count of equal packs at a time. The resulting patterns are joined
back to the documents by rank: the r-th piece of a length takes the r-th place that the patterns keep
for it. Ranks are made of counts by partition, so that no length's pieces meet in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, spread, stage, table, texts
from .tokens import encoder

WINDOW = 4096


def pack_histogram(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths in order) of each pattern, lengths longest first. A piece goes to the shortest pack that holds it,
    which is the one with the most room; only where none does, a new pack is opened.

    Equal pieces are placed a whole count of equal packs at a time; a count that is larger than what is left is split in two.
    The number of patterns is bounded by the number of bins, not by the number of pieces. Packs are linked lists, as they
    grow by a length at a time: (length, how often, rest of the pack).
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [how many packs, their contents]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        rooms = [-r for r, packs in by_room.items() if packs and r >= length]
        heapq.heapify(rooms)
        while left and rooms:
            room = -heapq.heappop(rooms)
            packs, smaller = by_room[room], room - length
            if not by_room[smaller] and smaller >= length:
                heapq.heappush(rooms, -smaller)
            while left and packs:
                n, held = packs.pop()
                if n > left:
                    packs.append([n - left, held])
                    n = left
                by_room[smaller].append([n, _with(held, length, 1)])
                left -= n
        # A new pack stays the shortest one until it holds no further piece of this length.
        each = window // length
        for n, times in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                by_room[window - times * length].append([n, _with(None, length, times)])
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in by_room.values():
        for n, held in packs:
            patterns[_contents(held)] += n
    return sorted(((n, lengths) for lengths, n in patterns.items()), key=lambda x: x[1], reverse=True)


def _with(held: tuple | None, length: int, times: int) -> tuple:
    """The pack ``held`` with ``times`` pieces of a length more."""
    if held and held[0] == length:
        return (length, held[1] + times, held[2])
    return (length, times, held)


def _contents(held: tuple | None) -> tuple[int, ...]:
    runs = []
    while held:
        length, times, held = held
        runs.append([length] * times)
    return tuple(x for run in reversed(runs) for x in run)


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length, runs of places in rank order: first rank, first sequence, offset. In a run rank and sequence rise together."""
    runs, sequence = defaultdict(list), 0
    taken: dict[int, int] = defaultdict(int)
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in runs.items()}


def padded_length(filled: int, window: int = WINDOW) -> int:
    """A sequence whose filled length is a power of two stays as it is; any other is padded to the window."""
    return filled if filled and filled & (filled - 1) == 0 else window


def _pieces(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(path)
        seen: dict[int, int] = defaultdict(int)  # a count for each length at most
        for batch in slices(batches, 256):
            coded = enc.encode(texts(batch, "text"))
            tail = np.array([end_id], "<u4").tobytes()
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coded):
                raw = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes() + tail
                n = len(raw) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, shard, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int64()])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "nth"])

    return run


def _placed(of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[a:b]
                firsts, sequences, offsets = of[int(length[mine[0]])]
                run_of = np.searchsorted(firsts, rank[mine], side="right") - 1
                sequence[mine] = sequences[run_of] + rank[mine] - firsts[run_of]
                offset[mine] = offsets[run_of]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """A row for each piece: where its ids lie in the document and in which sequence, at which offset.

    A null text is empty, which is the end id alone. Documents without an id, repeated rows and ties each
    keep their own pieces. An empty table gives no rows. Texts of any length are encoded whole, a text in one task, and cut
    into pieces. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(rows.mapInArrow(_pieces(tokenizer, end_id, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, nth long"), "pieces")
    counts = found.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.withColumn("before", before).drop("n")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    of = places(pack_histogram(histogram, window))
    ranked = found.join(firsts, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.mapInArrow(_placed(of), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (padded) and ``filled``, from ``pack_documents``' pieces.

    Ids tell documents apart here: they must be unique and not null (pieces of others would be joined to the wrong text). A null or empty
    text is its end id. A text's ids are one row, so that a text should fit a task. An empty table gives no rows.
    """

    def encoded(batches):
        enc = encoder(tokenizer)
        for batch in slices(batches, 256):
            ids = [np.append(np.frombuffer(x, enc.dtype).astype(np.int64), end_id) for x in enc.encode(texts(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "all_ids"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, "doc_id long, all_ids array<long>")
    rows = packed.join(ids, "doc_id").select("sequence_id", "offset", F.expr("slice(all_ids, int(start) + 1, int(length))").alias("ids"))
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``window`` ids
    whole = whole.select("sequence_id", F.flatten("parts.ids").alias("ids")).withColumn("filled", F.size("ids"))
    pad = F.when(F.expr("filled & (filled - 1)") == 0, F.lit(0)).otherwise(F.lit(window) - F.col("filled"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("ids"), "filled")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
