"""Spelling variants by a dictionary of trie-node pairs.

The vocabulary is counted over all texts, a task's own counts first. Its words are sorted and walked once forwards and once reversed,
which numbers the nodes of both tries: a word's node path keeps the last word's numbers as far as the two agree and goes on with new ones. A range
partition that begins inside a branch takes over the numbers of the one before it; for that, one word and one path of each partition
go through the driver.

A word cut at a place is a pair of integers (node of what stands before it, node of what stands after it). With the place's character
skipped, the pair is that of the word with this character deleted, and of every word that has another one there. So one grouping by pairs
brings together, exactly, all words that differ in this one place: those which skip it (as many as the alphabet has characters) and the
one word that lacks it. All members of a group are near each other, so that counts and the most frequent one follow from the group as
a whole, and no pairs are made. A character of a run of equal ones is skipped at several places for the same shorter word; it counts at the
last place only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove
from .common import slices, spread, stage, table, texts

LEAST_CHARS, LEAST_COUNT = 6, 5
#: A near word is a word's form if it occurs so many times as often.
TIMES = 5
#: One in so many (document, word) pairs is given a misspelling.
MISSPELT = 199
#: Distinct words that a task counts before it sends them on.
HELD = 300_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text: str) -> list[str]:
    return _RUN.findall(text.translate(_LOWER))


def misspelt(prefix: int, word: str) -> str:
    """The word, or what is left of it where the checksum says so; prefix: the checksum of what stands before the word."""
    h = zlib.crc32(word.encode(), prefix)
    return word if h % MISSPELT else word[: (at := h % len(word))] + word[at + 1 :]


def _counted(misspell: bool):
    """(word, n) of this task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for key, text in zip(batch.column("id").to_pylist(), texts(batch, "text")):
                own: dict[str, int] = {}
                for word in runs_of(text):
                    own[word] = own.get(word, 0) + 1
                prefix = zlib.crc32(f"{key or ''}:".encode())
                for word, n in own.items():
                    if misspell:
                        word = misspelt(prefix, word)
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield out()
                held = {}
        yield out()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: bool = False) -> DataFrame:
    """(word, n): the runs of letters in all texts, A-Z lower-cased; misspell: with a character deleted from a few, as the check needs."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(misspell), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings with their part and node path: numbers from 0 on in this part, of depth 0, 1 ..."""
    from pyspark import TaskContext

    part, count, before, path = TaskContext.get().partitionId(), 0, None, []
    for batch in slices(batches, 2048):
        paths = []
        for key in batch.column("key").to_pylist():
            same = 0
            if before is None:
                path, count = [0], 1
            else:
                most = min(len(key), len(before))
                while same < most and key[same] == before[same]:
                    same += 1
            path = [*path[: same + 1], *range(count, count + len(key) - same)]
            count += len(key) - same
            before = key
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(paths), pa.int32()), pa.array(paths, pa.list_(pa.int64()))], names=[*batch.schema.names, "part", "path"])


def numbered(words: DataFrame, key: Column, name: str) -> DataFrame:
    """The words with the column ``name``: the numbers of the trie's nodes from the root (the empty string) to ``key``.

    Equal prefixes have one number, others have others; of whole keys the greater one has the greater number.
    """
    rows = words.withColumn("key", key)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    local = stage(rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_numbered, f"{kinds}, part int, path array<long>"), f"trie-{name}")
    # A row for each part; the last word's path ends with the part's greatest number.
    parts = local.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path")).orderBy("part").collect()
    base, starts, inherited = 0, {}, {}
    before, outer = None, []
    for r in parts:
        same = -1
        if before is not None:
            same = 0
            while same < min(len(before), len(r.first)) and before[same] == r.first[same]:
                same += 1
        starts[r.part], inherited[r.part] = base, outer[: same + 1]
        outer = [outer[x] if x <= same else base + x for x in r.path]
        before, base = r.last, max(outer) + 1
    shared = words.sparkSession.sparkContext.broadcast((starts, inherited))  # a path for each part
    columns = words.columns

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, inherited = shared.value
        for batch in slices(batches, 2048):
            paths = []
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                known, start = inherited[part], starts[part]
                paths.append([known[x] if x < len(known) else start + x for x in path])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(paths, pa.list_(pa.int64()))], names=[*columns, name])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return local.select(*columns, "part", "path").mapInArrow(resolve, f"{shape}, {name} array<long>")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, after, id, n, skips, counts): each word's pairs, whole and with a character skipped. The id is the whole word's node."""
    for batch in slices(batches, 512):
        rows: list[tuple] = []
        for word, n, fore, back in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "fore", "back"))):
            size = len(word)
            key = fore[size]
            rows += [(fore[i], back[size - i], key, n, False, False) for i in range(size + 1)]
            rows += [(fore[i], back[size - i - 1], key, n, True, i + 1 == size or word[i] != word[i + 1]) for i in range(size)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["before", "after", "id", "n", "skips", "counts"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word that has any, its near words' number and the most frequent one as struct (n, id); ties: the least.

    words: word, n, fore and back (node paths). Groups are no larger than the alphabet and one more.
    """
    pairs = words.select("word", "n", "fore", "back").mapInArrow(_pairs, "before long, after long, id long, n long, skips boolean, counts boolean")
    member = F.struct(F.col("n"), (-F.col("id")).alias("order"), "skips", "counts")
    groups = pairs.groupBy("before", "after").agg(F.sort_array(F.collect_list(member), asc=False).alias("all")).filter("size(all) > 1 AND exists(all, x -> x.skips)")
    skipping = F.size(F.filter("all", lambda x: x["skips"]))
    told = groups.select("all", skipping.alias("skipping"), F.size(F.filter("all", lambda x: x["counts"])).alias("counting"), (F.size("all") > skipping).alias("whole"))
    first, second = F.col("all")[0], F.get("all", F.lit(1))

    def of(x: Column) -> Column:
        others = F.when(x["skips"], F.col("skipping") - 1 + (F.col("whole") & x["counts"]).cast("int")).otherwise(F.col("counting"))
        best = F.when(x["order"] == first["order"], second).otherwise(first)
        return F.struct((-x["order"]).alias("id"), others.cast("long").alias("near"), F.struct(best["n"].alias("n"), best["order"].alias("order")).alias("best"))

    each = told.select(F.explode(F.transform("all", of)).alias("x")).select("x.*")
    found = each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.order")).alias("id")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of links (id, form) without circles: each round doubles the way, so that the rounds are the logarithm of the longest one."""
    now = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("of"), F.col("root").alias("next"))
        then = stage(now.join(ahead, F.col("root") == F.col("of"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(now)
        if not then.filter("moved").limit(1).count():
            return then.select("id", "root")
        now = then.select("id", "root")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, misspell: bool = False) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``least_chars`` characters and ``least_count`` occurrences or more.

    Near words differ in one inserted, deleted or replaced character; the form is the most frequent of them (ties: the least in order of
    code points) if it occurs ``times`` times as often, else null. Null and empty texts have no words; a null id counts as an empty one. Repeated
    rows and copies count each. Texts and words of any length are taken whole. An empty table gives no rows. Other columns
    are left out, whatever their names. times: above 1, so that forms make no circles.
    """
    words = stage(word_counts(docs, id_col, text_col, misspell).filter((F.length("word") >= least_chars) & (F.col("n") >= least_count)), "words")
    fore = numbered(words, F.col("word"), "fore")
    both = stage(numbered(fore, F.reverse("word"), "back"), "paths")
    near = stage(near_words(both), "near")
    ids = stage(both.select(F.element_at("fore", -1).alias("id"), "word", "n"), "ids")
    formed = near.join(ids.select(F.col("id").alias("own"), F.col("n").alias("own_n")), F.col("id") == F.col("own")).filter(F.col("best.n") >= times * F.col("own_n")).select("id", F.col("best.id").alias("form"))
    formed = stage(formed, "forms")
    ends = roots(formed)
    named = lambda c: ids.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c), F.col("n").alias(f"{c}_n"))
    links = formed.join(ends.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select(F.col("id").alias("of_id"), F.col("form").alias("form_key"), F.col("root").alias("root_key"))
    links = links.join(named("form"), F.col("form_key") == F.col("form_id")).join(named("root"), F.col("root_key") == F.col("root_id")).select("of_id", "form", "form_n", "root")
    counts = near.select(F.col("id").alias("near_id"), "n_near")
    out = ids.join(counts, F.col("id") == F.col("near_id"), "left").join(links, F.col("id") == F.col("of_id"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_forms(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), misspell=True)
