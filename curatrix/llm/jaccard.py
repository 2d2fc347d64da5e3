"""Near-duplicate groups by exact Jaccard similarity of five-word shingles: operator 1's search, then a prefix-filtered set join.

Candidates come first of operator 1's method: SimHash fingerprints of the sets, their segment popcounts, the range join on grids of unit
cells, the Manhattan bound. Each is verified by the exact similarity. Many pairs of a similarity of 4/5 lie farther apart than fingerprints
can be searched, so a set join finds the rest; it leaves out what the search has linked.

In any one order of all shingles, two sets of similarity 4/5 or more share a shingle among the first n // 5 + 1 of each. The
order is rarest first: shingles that a sample of the texts shows to be common come last, by their counts. Which shingles the
sample finds changes the work, never the result. Shingles in two or more prefixes are cells; a count-min sketch of all prefixes
keeps most others from being sent at all. First each set is verified against one pivot, the set that leads most of its cells,
which joins a large group of copies in linear work, save where the two are linked. Sets of a cell that still lie in different components are compared
in pairs of bounded blocks, by size, position and a parity sketch as long as the set (the Hamming distance of two
sketches never exceeds the number of shingles in which the sets differ): first each set with the nearest one only, and then all
pairs that are left. Every pair that is left is verified by its exact
similarity before it links anything: the sets travel to their pivots, each once, and a pivot's members are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove
from .common import LOWER, content_key, slices, small, stage, texts
from .simhash import components, keep_first, label, within
from .substring_dedup import estimated, repeated_cells

SHINGLE = 5
#: Bits of a parity sketch: the least power of two that reaches the set's size, within these. The short one has LEAST_SKETCH.
LEAST_SKETCH, MOST_SKETCH = 256, 65_536
#: Bits of a cell's number in the count-min sketch of prefixes, at least and at most (64 MB).
LEAST_BITS, MOST_BITS = 16, 28
#: Sets that a task remembers to have sent.
REMEMBERED = 500_000
#: Members of a pivot that one task verifies.
DEALT = 2000
#: One in so many texts is counted to tell common shingles; COMMON of them make a shingle common.
SAMPLED = 8
COMMON = 8
#: Common shingles that the order knows, the most common first (about 3 MB); any others count as rare.
MOST_COMMON = 200_000
#: Rows of a cell that are compared at once.
BLOCK = 2048
#: Rows from which a cell is compared row by row, not together with others.
LARGE = 256


def shingle_sets(values: list[str], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's set of shingle hashes, ascending. A shorter text is one shingle; one without words has none."""
    from xxhash import xxh64_intdigest as h

    join = b" ".join
    for text in values:
        words = text.encode().translate(LOWER).split()
        if len(words) <= shingle:
            yield np.array([h(join(words), 42)] if words else [], np.uint64)
        else:
            yield np.unique(np.array([h(join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))], np.uint64))


def _ids(found: np.ndarray, bits: int) -> list[int]:
    """Two ids of a set, the halves of a 128-bit hash: the first, of so many bits, names it; the second tells sets apart that share it."""
    from xxhash import xxh3_128_intdigest as h

    x = h(found.tobytes(), 7)
    return np.array([x & ((1 << bits) - 1), x >> 64], np.uint64).view(np.int64).tolist()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        found = list(shingle_sets(texts(batch, "text")))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["shingle"])


def parity(found: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes, as 64-bit words: bit ``h mod length`` is flipped for each hash."""
    length = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (len(found) - 1).bit_length() if len(found) else 1))
    flips = np.bincount((found & np.uint64(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as operator 1 has it of a text's: a bit is set if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 65_536):
        ones += np.unpackbits(found[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def folded(sketches: np.ndarray) -> np.ndarray:
    """Rows of sketches at half their length."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


class Sketches:
    """The sketches of some rows; lengths differ by the sets' sizes. Sets within the similarity differ by one step of length at most."""

    def __init__(self, raw: list[bytes]):
        words = np.array([len(r) // 8 for r in raw], np.int64)
        self.length, self.place, self.rows = words, np.zeros(len(raw), np.int64), {}
        for n in np.unique(words).tolist():
            mine = np.flatnonzero(words == n)
            self.place[mine] = np.arange(len(mine))
            self.rows[n] = np.frombuffer(b"".join(raw[k] for k in mine.tolist()), np.uint64).reshape(-1, n)
        self.halves = {n: folded(x) for n, x in self.rows.items() if n > LEAST_SKETCH // 64}

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of the pairs (i, j): bounds from below of how many shingles their sets differ in."""
        out = np.zeros(len(i), np.int64)
        a, b = self.length[i], self.length[j]
        for n in self.rows:
            for one, two, mine in ((self.rows, self.rows, (a == n) & (b == n)), (self.rows, self.halves, (a == n) & (b == 2 * n)), (self.halves, self.rows, (a == 2 * n) & (b == n))):
                if mine.any():
                    left, right = (x[n if x is self.rows else 2 * n] for x in (one, two))
                    out[mine] = np.bitwise_count(left[self.place[i[mine]]] ^ right[self.place[j[mine]]]).sum(axis=1, dtype=np.int64)
        return out


def _prefixes(common: np.ndarray, weight: np.ndarray, id_bits: int):
    """common: ascending hashes; weight: their places in the order, above zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            nodes, checks, bits, sizes, sketches, shorts, prefixes = [], [], [], [], [], [], []
            for found in shingle_sets(texts(batch, "text")):
                node, check = _ids(found, id_bits)
                nodes.append(node)
                checks.append(check)
                bits.append(fingerprint(found))
                sizes.append(len(found))
                sketch = parity(found)
                sketches.append(sketch.tobytes())
                shorts.append(np.bitwise_xor.reduce(sketch.reshape(-1, LEAST_SKETCH // 64), axis=0).tobytes())
                if len(common) and len(found):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == found, weight[at], 0), kind="stable")]
                prefixes.append(found[: len(found) // 5 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(bits, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(shorts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "row_key", "text_key", "fp", "check", "bits", "size", "sketch", "short", "prefix"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("prefix").flatten().to_numpy().view(np.uint64)


def _cells(shared):
    """(node, size, at, cell) of the prefixes' shingles that the sketch estimates to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            prefix = batch.column("prefix")
            cells = prefix.flatten().to_numpy()
            n = np.diff(prefix.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(cells)) - np.repeat(np.cumsum(n) - n, n)
            kept = np.flatnonzero(estimated(sketch, cells.view(np.uint64)))
            mine = owner[kept]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("fp").to_numpy()[mine]), pa.array(batch.column("size").to_numpy()[mine]), pa.array(at[kept].astype(np.int32)), pa.array(cells[kept])], names=["node", "size", "at", "cell"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set for each place that it goes to; copies of a text send it once, or a few times where a task has very many sets."""
    sent: set[tuple[int, int, int]] = set()
    last: tuple[str | None, np.ndarray, int] = (None, np.zeros(0, np.uint64), 0)
    for batch in slices(batches, 256):
        out: list[tuple] = []
        for text, node, pivot, part, leads in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "pivot", "part", "leads"))):
            if (node, pivot, part) not in sent:
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add((node, pivot, part))
                if text != last[0]:
                    last = (text, next(shingle_sets([text or ""])), 0)
                out.append((node, pivot, part, leads, last[1].view(np.int64)))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())))], names=["node", "pivot", "part", "leads", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a pivot and a member whose exact similarity is 4/5 or more. Rows come by pivot and part, the pivot's own set first."""
    now, pivot = None, np.zeros(0, np.int64)
    for batch in batches:
        left, right = [], []
        flat, ends = batch.column("shingles").flatten().to_numpy(), np.cumsum(np.diff(batch.column("shingles").offsets.to_numpy())).tolist()
        for node, key, part, leads, a, b in zip(*(batch.column(c).to_pylist() for c in ("node", "pivot", "part", "leads")), [0, *ends[:-1]], ends):
            if leads:
                now, pivot = (key, part), flat[a:b].copy()
            else:
                assert now == (key, part)
                # Both are ascending as unsigned and free of repeats; the intersection sorts for itself.
                shared = len(np.intersect1d(pivot, flat[a:b], assume_unique=True))
                if 9 * shared >= 4 * (len(pivot) + b - a):
                    left.append(node)
                    right.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _near(size_a, at_a, size_b, at_b):
    """Whether sets whose first common shingle stands at these places can reach the similarity (columns or arrays)."""
    least = F.least if isinstance(size_a, Column) else np.minimum
    shared = least(size_a - at_a, size_b - at_b)
    return (5 * size_a >= 4 * size_b) & (5 * size_b >= 4 * size_a) & (9 * shared >= 4 * (size_a + size_b))


def _compare(nearest: bool):
    """Pairs (a, b, apart) of a cell that lie in different components and may be similar; rows come sorted by cell.

    nearest: of each row only the pair with the least distance of sketches, so that the pairs are no more than the rows.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        column = lambda name: rows.column(name).to_numpy()
        cell, node, root, size, at = (column(x) for x in ("cell", "node", "root", "size", "at"))
        order = np.lexsort((size, cell))
        sketches = Sketches(rows.column("sketch").take(pa.array(order)).to_pylist())
        cell, node, root, size, at = (x[order] for x in (cell, node, root, size.astype(np.int64), at.astype(np.int64)))
        starts, ends = (np.searchsorted(cell, cell, side=x) for x in ("left", "right"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            fits = np.flatnonzero(_near(size[i], at[i], size[j], at[j]))
            i, j = i[fits], j[fits]
            apart = sketches.apart(i, j)
            fits = np.flatnonzero(9 * apart <= size[i] + size[j])
            found.append((i[fits], j[fits], apart[fits]))

        for a in np.unique(starts[ends - starts >= LARGE]).tolist():
            # Pairs in the component that has the most rows are linked already: each other row meets all rows.
            z = int(ends[a])
            of, own = np.unique(root[a:z], return_inverse=True)
            most = own == np.argmax(np.bincount(own, minlength=len(of)))
            for k in (a + np.flatnonzero(~most)).tolist():
                i = a + np.flatnonzero((root[a:z] != root[k]) & (most | (np.arange(a, z) > k)))
                add(np.full(len(i), k), i)
                if nearest and len(found[-1][2]):
                    found[-1] = tuple(x[[np.argmin(found[-1][2])]] for x in found[-1])
        live, step = np.flatnonzero(ends - starts < LARGE), 1
        while len(live := live[live + step < ends[live]]):
            live = live[5 * size[live] >= 4 * size[live + step]]  # sizes ascend: no later one fits either
            i = live[root[live] != root[live + step]]
            add(i, i + step)
            step += 1
        i, j, apart = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if nearest:
            i, j, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
            order = np.lexsort((apart, i))
            order = order[np.append(True, np.diff(i[order]) != 0)] if len(order) else order
            a, b, apart = node[i[order]], node[j[order]], apart[order]
        else:
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            ab, first = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
            a, b, apart = ab[:, 0], ab[:, 1], apart[first]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart)], names=["a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            if not len(cells):
                continue
            # The last cell of a batch waits for the next one.
            cut = int(np.searchsorted(cells, cells[-1]))
            if held and (cut or held[-1].column("cell")[-1].as_py() != cells[0]):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is 4/5 or more. Sets are made again from the texts, of paired ones only,
    and go to b; where many go to one b, several tasks have it."""
    pairs = stage(pairs.select("a", "b"), "pairs")
    parts = pairs.groupBy(F.col("b").alias("of_b")).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    members = pairs.join(parts, F.col("b") == F.col("of_b")).select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.expr("cast(pmod(xxhash64(a, 3L), parts) as int)").alias("part"), F.lit(False).alias("leads"))
    pivots = parts.select(F.col("of_b").alias("node"), F.col("of_b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
    sent = members.union(pivots).join(distinct.select("fp", F.col("text_key").alias("of_key")), F.col("node") == F.col("fp")).drop("fp")
    sent = stage(sent, "sent")
    found = rows.join(small(sent), F.col("text_key") == F.col("of_key")).select("text", "node", "pivot", "part", "leads")
    sets = found.mapInArrow(_sets, "node long, pivot long, part int, leads boolean, shingles array<long>")
    checked = sets.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("leads")).mapInArrow(_verify, "a long, b long")
    checked = stage(checked.distinct(), "links")
    remove(sent)
    remove(pairs)
    return checked


def candidates(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, no more than there are sets, that connect just those which fingerprints within operator 1's bound connect.

    distinct: fp (a set's id) and bits (its fingerprint).
    """
    first = stage(distinct.groupBy("bits").agg(F.min("fp").alias("first")), "fingerprints")
    ends = [first.select(F.col("bits").alias(f"bits_{c}"), F.col("first").alias(f"first_{c}")) for c in "ab"]
    near = within(first.select(F.col("bits").alias("fp"))).join(ends[0], F.col("a") == F.col("bits_a")).join(ends[1], F.col("b") == F.col("bits_b"))
    same = distinct.select("fp", "bits").join(first, "bits").filter("fp != first")
    return near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).union(same.select("fp", "first"))


def links(rows: DataFrame, distinct: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect just those sets which pairs of similarity 4/5 or more connect.

    rows: text_key and text; distinct: fp (a set's id), text_key (of one text that has it), bits, sketch and short; cells: node (a fp), size,
    and the place ``at`` of a shingle ``cell`` of its prefix, each once.
    """
    searched = _verified(candidates(distinct), rows, distinct)
    lead = F.struct(F.xxhash64("node").alias("h"), "node", "size", "at")
    shared = cells.groupBy(F.col("cell").alias("of_cell")).agg(F.count("*").alias("n"), F.min(lead).alias("p")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    cells = stage(cells.join(shared, F.col("cell") == F.col("of_cell")).drop("of_cell"), "cells")
    # Each set is verified against the pivot that leads most of its cells.
    met = cells.filter(F.col("node") != F.col("p.node")).filter(_near(F.col("size"), F.col("at"), F.col("p.size"), F.col("p.at")))
    met = met.groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.count("*").alias("n"))
    met = met.groupBy("a").agg(F.max(F.struct("n", F.xxhash64("b").alias("h"), "b")).alias("p")).select("a", F.col("p.b").alias("b"))
    roots = stage(components(searched), "roots")
    for c in "ab":
        root = roots.select(F.col("node").alias("of"), F.col("root").alias(f"root_{c}"))
        met = met.join(root, F.col(c) == F.col("of"), "left").drop("of")
    met = met.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    found = searched.union(_verified(met, rows, distinct))

    # Sets that their pivot left out go to the nearest one of another component (if a short sketch tells sets of their size apart);
    # then all pairs that are left are compared.
    near = _by_cell(_rooted(cells, found).filter(F.col("size") <= 2 * LEAST_SKETCH), distinct, "short").mapInArrow(_compare(True), "a long, b long, apart long")
    found = found.union(_verified(near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("p")).select("a", F.col("p.b").alias("b")), rows, distinct))
    rest = _rooted(cells, found)
    mixed = rest.groupBy(F.col("cell").alias("of_cell")).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("of_cell")
    rest = rest.join(mixed, F.col("cell") == F.col("of_cell"), "left_semi")
    left = _by_cell(rest, distinct, "sketch").mapInArrow(_compare(False), "a long, b long, apart long").select("a", "b").distinct()
    return found.union(_verified(left, rows, distinct))


def _rooted(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of cells with the component that the links put them in."""
    roots = components(found).withColumnRenamed("node", "fp")
    return cells.join(roots, F.col("node") == F.col("fp"), "left").select("cell", "blocks", "node", "size", "at", F.coalesce("root", "node").alias("root"))


def _by_cell(rest: DataFrame, distinct: DataFrame, sketch: str) -> DataFrame:
    """Rows with one of their sketches, sorted by cell. Block b of a large cell meets each other block once: pair (least, most)."""
    rest = rest.join(distinct.select(F.col("fp").alias("node"), F.col(sketch).alias("sketch")), "node")
    rest = rest.withColumn("own", F.expr("cast(pmod(xxhash64(node, 7L), blocks) as int)")).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rest = rest.select("node", "root", "size", "at", "sketch", F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"))
    return rest.repartition("cell").sortWithinPartitions("cell")


def _named(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with an ``fp`` that is the set's alone, and the distinct sets. Sets that share an fp but not their other id get new ones."""
    clash = F.min("check") != F.max("check")
    turn = 0
    while True:
        kept = (F.min("text_key").alias("text_key"), F.any_value("bits").alias("bits"), F.any_value("sketch").alias("sketch"), F.any_value("short").alias("short"), clash.alias("clash"))
        distinct = stage(found.groupBy("fp").agg(*kept), "distinct")
        shared = distinct.filter("clash").select(F.col("fp").alias("of_fp"))
        if shared.isEmpty():
            return found, distinct.drop("clash")
        turn += 1
        again = found.join(small(shared), F.col("fp") == F.col("of_fp"), "left")
        again = again.withColumn("fp", F.when(F.col("of_fp").isNull(), F.col("fp")).otherwise(F.xxhash64("fp", "check", F.lit(turn)))).drop("of_fp")
        before, found = (found, distinct), stage(again, "prefixes")
        for done in before:
            remove(done)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, *, id_bits: int = 64) -> DataFrame:
    """doc_id, row_key, fp (an id of the text's set of shingles) and component_id for each row, as simhash_components.

    Sets are told apart by 128 bits of hash. Those few that share the first ``id_bits`` of them, by which they are shuffled, get ids anew.

    Null and empty texts and those without words are one group; texts of fewer than five words are alike only if equal. Repeated
    rows and copies fall into one component. Texts of any length are read whole; a text's set is held by one task. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_key(id_col, text_col).alias("row_key"), content_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sample = rows.filter(F.expr(f"pmod(xxhash64(text, 11L), {SAMPLED}) = 0")).select("text")
    counts = sample.mapInArrow(_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()  # bounded
    common, weight = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(common)
    found = stage(rows.mapInArrow(_prefixes(common[order], weight[order], id_bits), "doc_id long, row_key binary, text_key binary, fp long, check long, bits long, size int, sketch binary, short binary, prefix array<long>"), "prefixes")
    found, distinct = _named(found)
    total = found.agg(F.sum(F.size("prefix"))).first()[0] or 0
    sketch = repeated_cells(found.select("prefix"), min(MOST_BITS, max(LEAST_BITS, (4 * total).bit_length())), _hashes)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    cells = found.select("fp", "size", "prefix").mapInArrow(_cells(shared), "node long, size int, at int, cell long")
    cells = cells.groupBy("cell", "node").agg(F.any_value("size").alias("size"), F.any_value("at").alias("at"))
    return label(found.select("doc_id", "row_key", "fp"), lambda _: links(rows.select("text_key", "text"), distinct, cells, block))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that with the least id (ties: the least content key), with all its columns."""
    return keep_first(docs, jaccard_components(docs, id_col, text_col), id_col, text_col)
