"""Removal of repeated word windows, with a count-min prefilter.

The first pass sketches, the second groups exactly:

* Every window is represented in the sketch by its anchors: the hashed word runs (``ANCHOR`` words) that are the
  least of ``SPAN`` neighbouring ones. Equal windows have equal anchors at equal places, so all anchors of a window
  that starts twice occur twice; there are about six times fewer anchors than windows.
* Each partition makes a count-min sketch of its anchors. Partition sketches are merged slice by slice in
  a shuffle, counts saturating at two, and only the map of cells that were hit twice is kept and broadcast:
  ``2 ** bits * DEPTH / 8`` bytes, 64 MB at most, whatever the corpus. A cell never counts too few,
  so no repeated window is lost; in a corpus so large that the sketch fills up, more windows pass on.
* Windows of which all anchors are estimated to repeat are grouped exactly, on hashes of 95 bits. They travel packed: a task
  gathers the windows of many documents (a *flush*), groups those first, so that a window which many documents share passes on
  once a flush and no key is hot, and sends one binary of twelve bytes a window for each hash bucket. The
  bucket's task answers one bit for each of them, in their order, and the flush's documents take their bits in that
  order. Documents whose windows are all settled inside their flush, or that have none, wait for no answer.
* Buckets grow with the corpus and a flush does not, so a task deals to ``FAN`` buckets at most. Where there are more, hashes are dealt
  again, level by level: a task gathers what many flushes sent to one bucket, groups it, deals the rest to finer buckets and
  hands their answers back. So a binary holds about as many hashes at every size of corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, stage, table, texts

WINDOW = 35
ANCHOR = 12
#: Neighbouring word runs of which the least is an anchor.
SPAN = 12
#: Bits of a cell's number: as many cells a row of the sketch as four times the anchors (about one in 36 characters), within bounds.
LEAST_BITS, MOST_BITS = 20, 28
CHARS_PER_ANCHOR = 36
DEPTH = 2
SLICES = 64
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Word hashes that a Python worker remembers.
REMEMBERED = 500_000


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest as h

        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = h(w, 7)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``n`` (positions beyond the end are meaningless and stay)."""
    value, length = np.zeros_like(h), 0
    run, size, power = h, 1, base  # run: hashes of ``size`` words; power: base ** size, wrapped to 64 bits
    while n:
        if n & 1:  # append the next ``size`` words to what is gathered so far
            value = value * power + _ahead(run, length)
            length += size
        if n := n >> 1:
            run = run * power + _ahead(run, size)
            power, size = np.uint64(int(power) ** 2 % (1 << 64)), 2 * size
    return value


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return x
    out = np.zeros_like(x)
    if by < len(x):
        out[:-by] = x[by:]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def _running(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Least or most of each run of ``n``; the last n - 1 places see only what is left."""
    size = 1
    while 2 * size <= n:
        x = np.concatenate([pick(x[:-size], x[size:]), x[-size:]]) if size < len(x) else x
        size *= 2
    rest = n - size
    return np.concatenate([pick(x[:-rest], x[rest:]), x[-rest:]]) if 0 < rest < len(x) else x


class Windows:
    """Hashes and anchors of all windows of a batch of documents, laid end to end."""

    def __init__(self, docs: list[list[bytes]], hashes: WordHashes, window: int = WINDOW, anchor: int = ANCHOR):
        flat = [w for d in docs for w in d]
        self.n = np.array([len(d) for d in docs], np.int64)
        self.first = np.cumsum(self.n) - self.n
        end = np.repeat(self.first + self.n, self.n)
        place = np.arange(len(flat))
        self.h = hashes(flat)
        self.starts = place + window <= end  # a window of its document starts here
        grams = mixed(rolling(self.h, anchor, _B1)) | np.uint64(1)  # never 0, which stands for no window below
        span = SPAN
        self.least = _running(grams, span, np.minimum)  # where a span starts: its anchor
        self.spans = place + anchor + span - 1 <= end  # a span of its document starts here
        reached = np.where(self.spans, self.least, np.uint64(0))
        # A gram is an anchor if it is the least of some span that holds it: of those starting up to span - 1 before it.
        back = _running(reached[::-1], span, np.maximum)[::-1] if len(flat) else reached
        self.is_anchor = (back == grams) & (place + anchor <= end)
        self.grams = grams


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(anchors & mask).astype(np.int64), (anchors >> np.uint64(64 - bits)).astype(np.int64)][:DEPTH]


def sketch_bits(chars: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (4 * chars // CHARS_PER_ANCHOR).bit_length()))


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    hashes = WordHashes()
    for batch in slices(batches):
        w = Windows([t.encode().split() for t in texts(batch, "text")], hashes)
        yield w.grams[w.is_anchor]


def _sketch(bits: int, hashed):
    """This partition's sketch: by row of the sketch and slice, its cells hit once, and more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for found in hashed(batches):
            gathered.append(found)
            if sum(map(len, gathered)) > 4_000_000:
                yield _slices_of(np.concatenate(gathered), bits)
                gathered = []
        if gathered:
            yield _slices_of(np.concatenate(gathered), bits)

    return run


def _slices_of(anchors: np.ndarray, bits: int) -> pa.RecordBatch:
    cut = (1 << bits) // SLICES
    keys, once, more = [], [], []
    for row, cells in enumerate(_cells(anchors, bits)):
        cells, counts = np.unique(cells, return_counts=True)
        edges = np.searchsorted(cells, np.arange(SLICES + 1) * cut)
        for s in range(SLICES):
            a, b = edges[s], edges[s + 1]
            if a < b:
                own, many = (cells[a:b] - s * cut).astype("<u4"), counts[a:b] > 1
                keys.append(row * SLICES + s)
                once.append(own[~many].tobytes())
                more.append(own[many].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])


def _merge(bits: int):
    """Partition sketches of some slices, in slice order: one slice's two bit maps are held at a time."""
    cut = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, None, None

        def out():
            packed = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "twice"])

        for batch in batches:
            for key, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        yield out()
                    now, seen, twice = key, np.zeros(cut, bool), np.zeros(cut, bool)
                for raw, is_more in ((once, False), (more, True)):
                    cells = np.frombuffer(raw, "<u4")
                    twice[cells] |= seen[cells] | is_more
                    seen[cells] = True
        if now is not None:
            yield out()

    return run


def repeated_cells(rows: DataFrame, bits: int, hashed=anchors_of) -> np.ndarray:
    """The merged sketch as packed bits (DEPTH, 2 ** bits / 8): cells hit more than once. Its size is fixed.

    hashed: from Arrow batches of ``rows`` to the 64-bit hashes to count.
    """
    parts = rows.mapInArrow(_sketch(bits, hashed), "slice int, once binary, more binary")
    merged = parts.repartition(DEPTH * SLICES // 4, "slice").sortWithinPartitions("slice").mapInArrow(_merge(bits), "slice int, twice binary")
    found = np.zeros((DEPTH * SLICES, (1 << bits) // SLICES // 8), np.uint8)
    for r in merged.toLocalIterator():
        found[r.slice] = np.frombuffer(r.twice, np.uint8)
    return found.reshape(DEPTH, -1)


def estimated(sketch: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether each anchor is estimated to occur more than once."""
    out = np.ones(len(anchors), bool)
    for row, cells in enumerate(_cells(anchors, int(sketch.shape[1]).bit_length() + 2)):
        out &= (sketch[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
    return out


def _runs(places: np.ndarray) -> list[int]:
    """Ascending places as half-open runs: first, end, first, end ..."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) != 1)
    firsts, lasts = places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]
    return np.stack([firsts, lasts + 1], axis=1).ravel().tolist()


def _flags(runs: list[int] | None, n: int) -> np.ndarray:
    """Runs as flags of n places."""
    out = np.zeros(n, bool)
    for a, b in zip((runs or [])[::2], (runs or [])[1::2]):
        out[a:b] = True
    return out


def covered(starts: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:-1] > 0


#: Kinds of rows of the windows table: a document that is done, one that waits for answers, a bucket's hashes of a flush, the order
#: of a flush's hashes, and a bucket's answer to a flush.
DONE, WAITING, HASHES, ORDER, ANSWER = range(5)
#: Suspect windows and batches that a task holds before it groups them (about 60 MB).
HELD, HELD_BATCHES = 2_000_000, 32
#: Buckets that a task deals its hashes to: HELD hashes make binaries of some 3 kB, and two levels do for 2 ** 26 buckets (about 270 TB of text).
FAN = 8192
_KEY = np.dtype([("one", "<u8"), ("two", "<u4")])
_COLUMNS = (("kind", pa.int32()), ("flush", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("known", pa.list_(pa.int32())), ("asked", pa.list_(pa.int32())), ("bucket", pa.int32()), ("data", pa.binary()))
_SHAPE = "kind int, flush long, row long, n_words long, n_removed long, kept_sha256 string, text string, known array<int>, asked array<int>, bucket int, data binary"


def _rows(n: int, doc_id: pa.Array, **columns) -> pa.RecordBatch:
    """A batch of the windows table; columns that are not given are null."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _COLUMNS]
    return pa.RecordBatch.from_arrays([*arrays, doc_id], names=[*(c for c, _ in _COLUMNS), "doc_id"])


def _kept(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, str, str | None]:
    """Words removed, the digest of the rest and, where any was removed, the rest."""
    gone = covered(starts, len(words), window)
    n = int(gone.sum())
    rest = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n else words)
    return n, hashlib.sha256(rest).hexdigest(), rest.decode() if n else None


def _grouped(one: np.ndarray, two: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are there more than once (a sure one stands for several), and which are the first of their kind."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    repeats, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeats[order], first[order] = (np.bincount(group, 1 + sure[order]) > 1)[group], new
    return repeats, first


def _dealt(one: np.ndarray, two: np.ndarray, repeats: np.ndarray, first: np.ndarray, buckets: int) -> tuple[bytes, list[int], list[bytes]]:
    """The buckets of the hashes that ask, in their order; then each bucket that gets any, and its hashes.

    A hash that repeats here doesn't ask; one of its kind is sent as a sure one, for the others. Those that ask come first in a bucket.
    """
    sent = np.concatenate([np.flatnonzero(~repeats), np.flatnonzero(repeats & first)])
    asks = int((~repeats).sum())
    bucket = (one[sent] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(sent), np.int64)
    keys = np.zeros(len(sent), _KEY)
    keys["one"], keys["two"] = one[sent], two[sent] | (np.arange(len(sent)) >= asks)
    by = np.argsort(bucket, kind="stable")
    full, edges = np.unique(bucket[by], return_index=True)
    ends = [*edges[1:].tolist(), len(by)]
    return bucket[:asks].astype("<u4").tobytes(), full.tolist(), [keys[by[a:z]].tobytes() for a, z in zip(edges.tolist(), ends)]


def _in_order(order: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The buckets' answers in the order of the hashes that asked."""
    bits, by = np.zeros(len(order), bool), np.argsort(order, kind="stable")
    found, edges = np.unique(order[by], return_index=True)
    for b, a, z in zip(found.tolist(), edges.tolist(), [*edges[1:].tolist(), len(by)]):
        bits[by[a:z]] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=z - a).astype(bool)
    return bits


def _flushed(flush: int, held: list[tuple], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Group what is held, as a map-side combine: a window that repeats here is known to, and is sent once, for the others."""
    one, two = (np.concatenate([x[k] for x in held]) for k in (4, 5))
    repeats, first = _grouped(one, two, np.zeros(len(one), bool))
    done, row = 0, 0
    for ids, n_words, starts, owner, _, _, plain, whole in held:
        mine = repeats[done : done + len(starts)]
        done += len(starts)
        cuts = np.searchsorted(owner, np.arange(len(n_words) + 1)).tolist()
        kinds, removed, shas, shown, known, asked = [], [], [], [], [], []
        for text, sha, a, b in zip(plain, whole, cuts[:-1], cuts[1:]):
            sure = starts[a:b][mine[a:b]]
            ask = starts[a:b][~mine[a:b]]
            kinds.append(WAITING if len(ask) else DONE)
            n, rest = (None, text) if len(ask) else (0, None)
            if len(sure) and not len(ask):
                n, sha, rest = _kept(text.encode().split(), sure, window)
            removed.append(n)
            shas.append(sha)
            shown.append(rest)
            known.append(_runs(sure) if len(ask) else None)
            asked.append(_runs(ask) if len(ask) else None)
        yield _rows(len(n_words), ids, kind=kinds, flush=[flush] * len(n_words), row=np.arange(row, row + len(n_words)), n_words=n_words, n_removed=removed, kept_sha256=shas, text=shown, known=known, asked=asked)
        row += len(n_words)
    if len(one):
        order, full, data = _dealt(one, two, repeats, first, buckets)
        yield _rows(1, pa.nulls(1, ids.type), kind=[ORDER], flush=[flush], row=[-2], data=[order])
        yield _rows(len(full), pa.nulls(len(full), ids.type), kind=[HASHES] * len(full), flush=[flush] * len(full), row=[0] * len(full), bucket=full, data=data)


def _suspects(shared, buckets: int, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, flush = shared.value, TaskContext.get().partitionId() << 32
        hashes = WordHashes()
        held: list[tuple] = []
        for batch in slices(batches):
            plain = texts(batch, "text")
            docs = [t.encode().split() for t in plain]
            w = Windows(docs, hashes, window)
            again = np.zeros(len(w.h), bool)  # spans whose anchor is estimated to repeat
            spans = np.flatnonzero(w.spans)
            again[spans] = estimated(sketch, w.least[spans])
            starts = np.flatnonzero(w.starts & _running(again, window - ANCHOR - SPAN + 2, np.logical_and))
            one, two = (mixed(rolling(w.h, window, b))[starts] for b in (_B1, _B2))
            owner = np.repeat(np.arange(len(docs)), w.n)[starts]
            # Only texts with a suspect window are held; of the others the digest.
            has = np.bincount(owner, minlength=len(docs)) > 0
            shas = [None if s else hashlib.sha256(b" ".join(d)).hexdigest() for d, s in zip(docs, has)]
            held.append((batch.column("doc_id"), w.n, starts - w.first[owner], owner, one, (two >> np.uint64(33)).astype("<u4") << np.uint32(1), [t if s else None for t, s in zip(plain, has)], shas))
            del docs, plain, w
            if sum(len(x[2]) for x in held) > most or len(held) >= HELD_BATCHES:
                yield from _flushed(flush, held, buckets, window)
                held, flush = [], flush + 1
        if held:
            yield from _flushed(flush, held, buckets, window)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, of rows sorted by bucket, one bit for each hash that asks: whether it is there twice."""

    def answered(bucket: int, flushes: list[int], data: list[bytes]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(data), _KEY)
        sure = (keys["two"] & 1).astype(bool)
        repeats, _ = _grouped(keys["one"], keys["two"] >> 1, sure)
        edges = np.cumsum([0, *(len(x) // _KEY.itemsize for x in data)]).tolist()
        bits = [np.packbits(repeats[a:b][~sure[a:b]]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(flushes), pa.int32()), pa.array(flushes, pa.int64()), pa.array(bits, pa.binary())], names=["bucket", "flush", "data"])

    now, flushes, data = None, [], []
    for batch in batches:
        for bucket, flush, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "flush", "data"))):
            if bucket != now:
                if flushes:
                    yield answered(now, flushes, data)
                now, flushes, data = bucket, [], []
            flushes.append(flush)
            data.append(raw)
    if flushes:
        yield answered(now, flushes, data)


_GROUPS = "kind int, flush long, bucket int, data binary, known binary, of array<long>, asks array<int>"


def _regrouped(buckets: int, most: int):
    """What many flushes sent to a bucket, of rows sorted by bucket, gathered into groups and dealt to finer buckets.

    A group is to the next level what a flush is to this one. Its order tells, too, which of the hashes that asked it
    repeat inside the group, and how many each flush asked.
    """

    def grouped(group: int, bucket: int, flushes: list[int], data: list[bytes]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(data), _KEY)
        one, two, sure = keys["one"], keys["two"] & ~np.uint32(1), (keys["two"] & 1).astype(bool)
        repeats, first = _grouped(one, two, sure)
        edges = np.cumsum([0, *(len(x) // _KEY.itemsize for x in data)]).tolist()
        asks = [int((~sure[a:b]).sum()) for a, b in zip(edges[:-1], edges[1:])]
        order, full, sent = _dealt(one, two, repeats, first, buckets)
        n = len(full)
        columns = ([ORDER] + [HASHES] * n, [group] * (n + 1), [bucket, *full], [order, *sent], [np.packbits(repeats[~sure]).tobytes()] + [None] * n, [flushes] + [None] * n, [asks] + [None] * n)
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["kind", "flush", "bucket", "data", "known", "of", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 32
        now, flushes, data, size = None, [], [], 0
        for batch in batches:
            for bucket, flush, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "flush", "data"))):
                if flushes and (bucket != now or size > most * _KEY.itemsize):
                    yield grouped(group, now, flushes, data)
                    group, flushes, data, size = group + 1, [], [], 0
                now = bucket
                flushes.append(flush)
                data.append(raw)
                size += len(raw)
        if flushes:
            yield grouped(group, now, flushes, data)

    return run


def _handed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's answers as those of its bucket to each of its flushes. Rows come by group: its order, then the finer buckets' answers."""

    def handed(order: dict, answers: dict[int, bytes]) -> pa.RecordBatch:
        told = np.unpackbits(np.frombuffer(order["known"], np.uint8), count=sum(order["asks"])).astype(bool)
        told[~told] = _in_order(np.frombuffer(order["data"], "<u4"), answers)
        edges = np.cumsum([0, *order["asks"]]).tolist()
        bits = [np.packbits(told[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([order["bucket"]] * len(bits), pa.int32()), pa.array(order["of"], pa.int64()), pa.array(bits, pa.binary())], names=["bucket", "flush", "data"])

    order, answers = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == ORDER:
                if order:
                    yield handed(order, answers)
                order, answers = row, {}
            else:
                answers[row["bucket"]] = row["data"]
    if order:
        yield handed(order, answers)


def _answered(hashes: DataFrame, dealt: int, buckets: int, fan: int, held: int) -> DataFrame:
    """(bucket, flush, data): for each flush and bucket a bit for each hash that asks.

    hashes: (bucket, flush, data) of ``dealt`` buckets. Where that is fewer than ``buckets``, they are dealt on, by as many tasks for a
    bucket as it has finest ones.
    """
    if dealt >= buckets:
        return hashes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers, "bucket int, flush long, data binary")
    finer = min(buckets, dealt * fan)
    parts = hashes.repartition("bucket", F.pmod(F.xxhash64("flush"), F.lit(buckets // dealt))).sortWithinPartitions("bucket")
    groups = stage(parts.mapInArrow(_regrouped(finer, held), _GROUPS), "groups")
    back = _answered(groups.filter(F.col("kind") == HASHES).select("bucket", "flush", "data"), finer, buckets, fan, held)
    waiting = groups.filter(F.col("kind") == ORDER).unionByName(back.withColumn("kind", F.lit(ANSWER)), allowMissingColumns=True)
    return waiting.repartition("flush").sortWithinPartitions("flush", "kind").mapInArrow(_handed_back, "bucket int, flush long, data binary")


def _finish(window: int):
    """Waiting documents with their answers. Rows come by flush: its order, then its answers, then its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, order, answers, bits, at = None, None, {}, None, 0
        for batch in batches:
            ids, n_words, removed, shas, shown = [], [], [], [], []
            place = 0
            for kind, flush, text, known, asked, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "flush", "text", "known", "asked", "bucket", "data"))):
                if flush != now:
                    now, answers, bits, at = flush, {}, None, 0
                if kind == ORDER:
                    order = np.frombuffer(data, "<u4")
                elif kind == ANSWER:
                    answers[bucket] = data
                else:
                    if bits is None:
                        bits = _in_order(order, answers)
                    words = text.encode().split()
                    ask = np.flatnonzero(_flags(asked, len(words)))
                    told = bits[at : at + len(ask)]
                    at += len(ask)
                    n, sha, rest = _kept(words, np.concatenate([np.flatnonzero(_flags(known, len(words))), ask[told]]), window)
                    ids.append(place)
                    n_words.append(len(words))
                    removed.append(n)
                    shas.append(sha)
                    shown.append(rest)
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, fan: int = FAN, held: int = HELD) -> DataFrame:
    """n_words, n_removed, kept_sha256 and, where words were removed, kept_text for each row.

    Null and empty texts and those shorter than a window lose nothing. Repeated rows and copies count as two documents,
    so all their windows go. Texts of any length are judged whole; a text is held by one task. An empty table gives no rows.
    Other columns are left out. window: ANCHOR + SPAN - 1 words at least. fan: buckets that a task deals to, a power of two; held: hashes
    that it holds meanwhile.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    sketch = repeated_cells(rows.select("text"), sketch_bits(size))
    # About a million hashes a bucket where every character of the text starts a word of a repeated window.
    buckets = 1 << max(6, (size // 4_000_000).bit_length())
    dealt = min(buckets, fan)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    found = stage(rows.mapInArrow(_suspects(shared, dealt, window, held), f"{_SHAPE}, doc_id {kind}"), "windows")
    hashes = found.filter(F.col("kind") == HASHES).select("bucket", "flush", "data")
    answers = _answered(hashes, dealt, buckets, fan, held)
    columns = ["kind", "flush", "row", "text", "known", "asked", "bucket", "data", "doc_id"]
    told = answers.select(F.lit(ANSWER).alias("kind"), "flush", F.lit(-1).cast("long").alias("row"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("text", "known", "asked")), "bucket", "data", F.lit(None).cast(kind).alias("doc_id"))
    waiting = found.filter(F.col("kind").isin(WAITING, ORDER)).select(columns).unionByName(told)
    cut = waiting.repartition("flush").sortWithinPartitions("flush", "row").mapInArrow(_finish(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return found.filter(F.col("kind") == DONE).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("text").alias("kept_text")).union(cut)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(table(spark, sf_dir, "documents"))).drop("kept_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p SEMI JOIN r USING (s)),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.j) AS text, count(*) AS n FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.j = c.j GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
