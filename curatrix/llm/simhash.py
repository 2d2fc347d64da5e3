"""Near-duplicate search on SimHash fingerprints by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its vector of bit counts. The
Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints, so fingerprints
within ``MOST_BITS`` bits lie within that Manhattan distance. The range join runs on grids of unit cells: the
32 coordinates are cut into two halves, and of a distance of at most three at most one falls to one of the
halves. So each vector stands in its own cell of both grids and in the neighbouring cells one step up; two vectors
within the range meet in a cell where one of them is at home. There the Manhattan distance of the whole vectors
rules out most pairs and the fingerprints themselves decide. From ``FINER_FROM`` distinct fingerprints on the grids span
two thirds of the coordinates (four of six groups), which takes ten times the rows and a fourteenth of the candidates.
Cells with one fingerprint go before anything is compared, cells with many are compared in pairs of bounded blocks, and each
comparison returns a spanning forest, not all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import remove
from .common import LOWER, content_key, free_name, slices, small, spread, stage, table, texts

MOST_BITS = 3
SHINGLE = 3
#: Fingerprints of a cell that are compared at once; larger cells are dealt out in pairs of such blocks.
BLOCK = 2048
#: Distinct fingerprints from which finer grids pay: candidates of a row grow with them, rows don't.
FINER_FROM = 1 << 31
#: (coordinates of each group, groups that a grid spans).
COARSE, FINER = ((16, 16), 1), ((6, 6, 5, 5, 5, 5), 4)
_EVEN = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grids(groups: tuple[int, ...], spanned: int) -> list[tuple[int, list[int]]]:
    """The mask and the coordinates of each grid: all choices of ``spanned`` groups.

    However MOST_BITS steps fall on the groups, some choice has at most one of them, which its cells' neighbours cover.
    """
    spread = (x for x in itertools.product(range(MOST_BITS + 1), repeat=len(groups)) if sum(x) == MOST_BITS)
    assert max(sum(sorted(x)[:spanned]) for x in spread) <= 1
    firsts = [sum(groups[:k]) for k in range(len(groups))]
    found = []
    for chosen in itertools.combinations(range(len(groups)), spanned):
        coordinates = [c for g in chosen for c in range(firsts[g], firsts[g] + groups[g])]
        found.append((sum(3 << 2 * c for c in coordinates), coordinates))
    return found


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in slices(batches, 256):
            hashes: list[int] = []
            counts = []
            for text in texts(batch, "text"):
                words = text.encode().translate(LOWER).split()
                if not words:
                    counts.append(0)
                elif len(words) < shingle:
                    hashes.append(h(b" ".join(words), 42))
                    counts.append(1)
                else:
                    join = b" ".join
                    hashes += [h(join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))]
                    counts.append(len(words) - shingle + 1)
            n = np.array(counts, np.int64)
            fps = np.zeros(len(n), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int64)
                fps[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(fps.view(np.int64))], names=[*(c for c in batch.schema.names if c != "text"), "fp"])

    return run


def counts_vector(fp: Column) -> Column:
    """The 32 segments' bit counts, two bits each: the sum of a segment's bits, as exclusive or and carry."""
    a, b = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of two packed vectors of bit counts."""
    low, high, one = np.uint64(0x3333333333333333), np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)
    total = np.zeros(len(a), np.uint8)
    for shift in (np.uint64(0), np.uint64(2)):
        t = (((a >> shift) & low) | high) - ((b >> shift) & low)  # each nibble: 8 and the difference
        total += np.bitwise_count(t & one) + np.uint8(2) * np.bitwise_count((t >> np.uint64(1)) & ~t & one)
    return total


def _vector(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(_EVEN))


def forest(cell: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells as places (i, root of i): a spanning forest of those within MOST_BITS of one that is at home.

    Rows come sorted by cell, those at home first.
    """
    n = len(fp)
    root = np.arange(n)
    vector = _vector(fp)
    ends = np.searchsorted(cell, cell, side="right")
    live, step = np.flatnonzero(home), 1
    while len(live := live[live + step < ends[live]]):
        i = live[root[live] != root[live + step]]
        i = i[manhattan(vector[i], vector[i + step]) <= MOST_BITS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= MOST_BITS]
        while len(i):  # hook the larger root to the smaller one until all pairs have one root
            a, b = root[i], root[i + step]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
            i = i[root[i] != root[i + step]]
        step += 1
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch waits for the next one."""

    def linked(cells, homes, fps):
        order = np.lexsort((~homes, cells))
        fp = fps[order].view(np.uint64)
        i, r = forest(cells[order], homes[order], fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[r].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []  # parts of one cell
    for batch in batches:
        rows = (batch.column("cell").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy())
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and (cut or held[0][0][0] != rows[0][0]):
            held.append(tuple(x[:cut] for x in rows))
            yield linked(*(np.concatenate(x) for x in zip(*held)))
            held = []
        elif cut:
            yield linked(*(x[:cut] for x in rows))
        held.append(tuple(x[cut:] for x in rows))
    if held:
        yield linked(*(np.concatenate(x) for x in zip(*held)))


def _stands(k: int, mask: int, coordinates: list[int]) -> Column:
    """(grid, cell, home) of one grid: a vector's own cell and the next one up in each coordinate that has one."""
    vector = F.col("vector")
    own = vector.bitwiseAND(F.lit(_signed(mask)).cast("long"))
    units = F.filter(F.array(*(F.lit(_signed(1 << 2 * c)).cast("long") for c in coordinates)), lambda u: vector.bitwiseAND(F.shiftleft(u, 1)) == 0)  # a count of two has none

    def row(cell: Column, home: bool) -> Column:
        return F.struct(F.lit(k).alias("grid"), cell.alias("cell"), F.lit(home).alias("home"))

    def up(u: Column) -> Column:
        return own.bitwiseXOR(F.when(own.bitwiseAND(u) == 0, u).otherwise(u.bitwiseOR(F.shiftleft(u, 1))))

    return F.concat(F.array(row(own, True)), F.transform(units, lambda u: row(up(u), False)))


def cells(fingerprints: DataFrame, kind: tuple[tuple[int, ...], int] = COARSE) -> DataFrame:
    """(fp, grid, cell, home): the cells that each fingerprint stands in, its own and those one step up."""
    stands = F.concat(*(_stands(k, *grid) for k, grid in enumerate(grids(*kind))))
    rows = fingerprints.select("fp", counts_vector(F.col("fp")).alias("vector"))
    return rows.select("fp", F.explode(stands).alias("c")).select("fp", "c.grid", "c.cell", "c.home")


def links(fingerprints: DataFrame, block: int = BLOCK, kind: tuple[tuple[int, ...], int] = COARSE) -> DataFrame:
    """Links (a, b) that connect just those distinct fingerprints which pairs within MOST_BITS connect.

    fingerprints: one column ``fp``, each value once.
    """
    rows = cells(fingerprints, kind)
    shared = rows.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.bool_or("home").alias("lived")).filter("n > 1 AND lived")
    shared = shared.select(F.col("grid").alias("of_grid"), F.col("cell").alias("of_cell"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(shared, (F.col("grid") == F.col("of_grid")) & (F.col("cell") == F.col("of_cell"))).select("fp", "grid", "cell", "home", "blocks")
    # Block b of a large cell meets each other block once: pair (least, most).
    own = F.expr("cast(pmod(xxhash64(fp, 7L), blocks) as int)")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("fp", "home", F.xxhash64("grid", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, root the least node that can be reached; alternating large and small stars.

    Each round is a written table, so that a lost executor never sets it back to the start.
    """
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("of")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(least, F.col("u") == F.col("of"))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        done, edges = edges, stage(small, "edges")
        remove(done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (least doc_id of all documents that links reach) for each row.

    Null and empty texts have fingerprint zero, which links like any other. Rows without an id keep a row
    each and take part with their text; a component of such rows only has a null id. Repeated rows fall
    into one component. An empty table gives no rows. Texts of any length are read whole; a text's shingle
    hashes are held by one task. Other columns are left out, save ``row_key``, the content key of id and text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    found = stage(rows.mapInArrow(_fingerprints(shingle), "doc_id long, row_key binary, fp long"), "fingerprints")
    return label(found)


def within(fingerprints: DataFrame) -> DataFrame:
    """Links of distinct fingerprints on the grids that suit their number."""
    return links(fingerprints, kind=FINER if fingerprints.count() >= FINER_FROM else COARSE)


def label(found: DataFrame, find=within) -> DataFrame:
    """Add component_id to rows with doc_id and fp; ``find`` gives the links of distinct values of fp."""
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(find(distinct.select("fp")))
    tops = roots.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    members = roots.union(tops).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least")
    least = members.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of_root")
    near = members.join(least, F.col("root") == F.col("of_root")).select("fp", "component_id")
    alone = distinct.filter("copies > 1").join(near, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    of = near.union(alone).withColumnRenamed("fp", "of_fp")
    return found.join(of, F.col("fp") == F.col("of_fp"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("of_fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component stays, that with the least id (ties: the least content key), with all its columns.

    Rows without an id are only dropped for a component that has one with an id, or all but one of their own.
    """
    return keep_first(docs, simhash_components(docs, id_col, text_col, shingle), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each component of ``found`` (doc_id, row_key, fp, component_id).

    Keys of rows that go, and of rows that occur more than once, are few as a rule: where they are, no text is shuffled.
    """
    key, rank, of_key = (free_name(docs, x) for x in ("row_key", "row_rank", "of_key"))
    group = F.coalesce(F.concat(F.lit("c"), F.col("component_id").cast("string")), F.concat(F.lit("f"), F.col("fp").cast("string")))
    grouped = stage(found.select(group.alias("group"), "doc_id", "row_key"), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("x"), F.count("*").alias("n"))
    many = grouped.join(small(stage(first.filter("n > 1").select(F.col("group").alias("of_group"), F.col("x.row_key").alias("first_key")), "groups")), F.col("group") == F.col("of_group"))
    # A key of a group of several rows: it goes, or it is the first one's, and may stand there more than once.
    told = stage(many.groupBy(F.col("row_key").alias(of_key)).agg((F.count_if(F.col("row_key") == F.col("first_key")) == 0).alias("goes"), F.count("*").alias("n")), "told")
    rows = docs.withColumn(key, content_key(id_col, text_col))
    alone = rows.join(small(told.filter("goes OR n > 1").select(of_key)), F.col(key) == F.col(of_key), "left_anti")
    again = rows.join(small(told.filter("NOT goes AND n > 1").select(of_key)), F.col(key) == F.col(of_key), "left_semi")
    again = again.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(rank) == 1)
    return alone.select(*docs.columns).union(again.select(*docs.columns))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
