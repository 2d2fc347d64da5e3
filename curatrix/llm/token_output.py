"""Token-ID output in Simple-8b: words of 64 bits that each pack as many ids as their width allows.

File format. A record holds one document: ``payload`` is a run of little-endian 64-bit words, in blocks
of ``BLOCK`` ids (the last may be shorter); ``offsets[b]`` is the first word of block b, so that any
block can be decoded alone and all blocks together. A word's upper 4 bits select how many ids of how
many bits its lower 60 bits hold (``PACKS``, lowest bits first). Selector 15 escapes: the next whole
word is one id of up to 64 bits. Records lie in shards by ascending document id, ties by text;
``local_start`` counts the ids before the record in its shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, table, texts
from .tokens import encoder

BLOCK = 256
#: (ids, bits of each) by selector, most ids first.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.array([n for n, _ in PACKS])
_BITS = np.array([b for _, b in PACKS])
_WIDEST = 60


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    if ids.max() < 1 << 16:
        return _BIT_LENGTHS[ids]
    out = np.ones(len(ids), np.uint8)
    for shift in range(1, 64):
        rest = ids >> np.uint64(shift)
        if not rest.any():
            break
        out[rest > 0] = shift + 1
    return out


_BIT_LENGTHS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack the documents of one batch, all their blocks side by side.

    ids: uint64 ids of all documents, one after another; lengths: ids of each document.
    Returns the words, each document's number of words, and the words of each block (blocks in order).
    """
    per = -(-lengths // block)
    of = np.repeat(np.arange(len(lengths)), per)
    firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    rank = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start = firsts[of] + rank * block
    end = np.minimum(start + block, (firsts + lengths)[of])
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(len(lengths), np.int64), np.zeros(0, np.int64)
    # The widest of the next 1, 2, 3 ... ids, by selector; a pack fits where that is within its bits.
    choice = np.full(n, ESCAPE, np.uint8)
    widest, reach = bit_lengths(ids), 1
    for selector in range(len(PACKS) - 1, -1, -1):  # the packs' counts rise by at most doubling
        count, bits = PACKS[selector]
        wide = np.full(n, 255, np.uint8)
        if (room := n - count + 1) > 0:
            np.maximum(widest[:room], widest[count - reach : count - reach + room], out=wide[:room])
            choice[wide <= bits] = selector
        widest, reach = wide, count
    left = np.zeros(n, np.int64)  # ids up to the end of the block
    left[:] = np.repeat(end, end - start) - np.arange(n)
    fits = np.searchsorted(-_COUNTS, -np.minimum(left, 60))  # first selector with no more ids than are left
    choice = np.where(choice == ESCAPE, ESCAPE, np.maximum(choice, fits)).astype(np.uint8)
    # Walk all blocks in step: each round makes every unfinished block's next word.
    at, live, heads, owners = start.copy(), np.arange(len(start)), [], []
    steps = np.append(_COUNTS, [1, 1])
    while len(live):
        heads.append(at[live])
        owners.append(live)
        at[live] += steps[choice[at[live]]]
        live = live[at[live] < end[live]]
    head, owner = np.concatenate(heads), np.concatenate(owners)
    order = np.lexsort((head, owner))
    head, owner = head[order], owner[order]
    chosen = choice[head]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), "<u8")
    for selector, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            value = np.full(len(mine), selector << 60, np.uint64)
            for k in range(count):
                value |= ids[head[mine] + k] << np.uint64(k * bits)
            words[place[mine]] = value
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = ids[head[escaped]]
    by_block = np.bincount(owner, weights=size, minlength=len(start)).astype(np.int64)
    by_doc = np.bincount(of, weights=by_block, minlength=len(lengths)).astype(np.int64)
    return words, by_doc, by_block


def decode_blocks(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All ids of a run of blocks. Only blocks with an escape are walked word by word."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that follow an escape
    marked = selector == ESCAPE
    if marked.any():
        ends = np.append(offsets[1:], len(words))
        touched = np.unique(np.searchsorted(offsets, np.flatnonzero(marked), side="right") - 1)
        for a, b in zip(offsets[touched].tolist(), ends[touched].tolist()):
            i = a
            while i < b:
                if selector[i] == ESCAPE:
                    raw[i + 1] = True
                    i += 1
                i += 1
    counts = np.append(_COUNTS, [0, 0])[selector]
    counts[raw] = 1
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[first[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    out[first[raw]] = words[raw]
    return out


_RECORD = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("offsets", pa.list_(pa.int32()))])


def _records(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            coded = enc.encode(texts(batch, "text"))
            tail = np.array([end_id], enc.dtype).tobytes()
            ids = np.frombuffer(b"".join(x + tail for x in coded), enc.dtype).astype(np.uint64)
            lengths = np.array([len(x) // enc.width + 1 for x in coded])
            words, by_doc, by_block = encode_blocks(ids, lengths)
            raw, word, block = words.tobytes(), 0, 0
            payloads, offsets = [], []
            for n, k in zip(by_doc.tolist(), (-(-lengths // BLOCK)).tolist()):
                payloads.append(raw[8 * word : 8 * (word + n)])
                sizes = by_block[block : block + k]
                offsets.append((np.cumsum(sizes) - sizes).astype(np.int32))
                word, block = word + n, block + k
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coded), shard, np.int32)), batch.column("doc_id"), pa.array(starts), pa.array(lengths), pa.array(payloads, pa.binary()), pa.array(offsets, pa.list_(pa.int32()))], schema=_RECORD)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode each document, append ``end_id`` and write the records in ascending id order; returns the files as read back.

    A null text is empty (one id, the end); documents without an id come first; repeated rows each get a
    record; an empty table gives an empty file; other columns are left out. Texts of any length are encoded whole, a text in one
    task. The texts are range-partitioned
    once; only a partition's own order and its running count of ids are kept in its task.
    """
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.length("text")).sortWithinPartitions("doc_id", "text")
    return stage(rows.mapInArrow(_records(tokenizer, end_id), T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])), "tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        payloads, offsets = batch.column("payload").to_pylist(), batch.column("offsets")
        words = np.frombuffer(b"".join(payloads), "<u8")
        n_words = np.array([len(p) // 8 for p in payloads], np.int64)
        base = np.cumsum(n_words) - n_words
        per = np.array([len(x) for x in offsets], np.int64)
        flat = np.asarray(offsets.flatten(), dtype=np.int64) + np.repeat(base, per)
        ids = decode_blocks(words, flat).astype("<u4").tobytes()
        at, crcs = 0, []
        for n in batch.column("n_tokens").to_pylist():
            crcs.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            at += n
        assert 4 * at == len(ids)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("local_start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """Decode the files: per document its place among all ids, its number of ids and their CRC."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select(F.col("shard").alias("of_shard"), before.alias("base"))
    rows = files.mapInArrow(_digest, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, F.col("shard") == F.col("of_shard")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
