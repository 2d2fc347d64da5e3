"""Line dedup by log templates.

A fixed-depth tree sorts lines: first by their number of tokens, then by their ``LEAD`` leading tokens, with
variable fields (tokens with a digit) replaced by a wildcard throughout. Below a leaf, lines that stand in ``least`` texts as
they are make templates of their own; the others have two: a token stays where lines of ``least`` texts of the leaf share it at
its position, and where also SHARE of the leaf's do, so that the values of a variable word field go at every size; any other
token becomes the wildcard. A line of variable fields alone stands for itself, as it is. A template that stands in ``least`` or more different texts recurs, and its lines go, whatever
stands around them. A document that was copied many times with an edit here and there consists of recurring lines all but
wholly: a text in which candidates hold more than ``most`` of the tokens doesn't count for a template (else all copies would
lose everything), and is left to near-dedup; recurring templates still go from it. The share follows from what a near copy is: two texts
of n tokens of a similarity of 0.8 or more share eight ninths of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, free_name, slices, small, spread, stage, table, texts

WILDCARD = "<*>"
LEAD = 3
LEAST_DOCS = 10
#: Share of a text's tokens that recurring lines hold at most if the text is to count for their templates.
MOST_RECURRING = 8 / 9
#: Share of tokens that a generalised template keeps.
LEAST_FIXED = 0.6
#: Share of a leaf's lines that fix a token in the wider of a line's two templates.
SHARE = 0.1

_VARIABLE = re.compile(r"(?<!\S)[^\s\d]*\d\S*")
_DIGIT = re.compile(r"\d")
_M = (1 << 63) - 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has a token; ``size`` counts the tokens of the whole text."""
    from xxhash import xxh3_64_intdigest as h

    for batch in slices(batches):
        keys, numbers, tokens, sizes, leaves, hashes, masked = [], [], [], [], [], [], []
        for key, text in zip(batch.column("row_key").to_pylist(), texts(batch, "text")):
            plain = text.split("\n") if _DIGIT.search(text) else None
            if plain:
                text = _VARIABLE.sub(WILDCARD, text)
            split = [(number, found) for number, line in enumerate(text.split("\n")) if (found := line.split())]
            size = sum(len(found) for _, found in split)
            for number, found in split:
                fixed = any(x != WILDCARD for x in found) or not plain
                line = " ".join(found if fixed else plain[number].split())
                leaf = f"{len(found)} {' '.join(found[:LEAD])}" if fixed else f"as it is {line}"
                keys.append(key)
                numbers.append(number)
                tokens.append(len(found))
                sizes.append(size)
                leaves.append(h(leaf) & _M)
                hashes.append(h(line if fixed else leaf) & _M)
                masked.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(x, pa.int32()) for x in (numbers, tokens, sizes)), *(pa.array(x, pa.int64()) for x in (leaves, hashes)), pa.array(masked, pa.string())], names=["row_key", "line", "tokens", "size", "leaf", "own", "masked"])


def _generalised(varied: DataFrame, least: int, fixed: float) -> DataFrame:
    """(of_own, template): up to two templates of each distinct line (own, leaf, n texts, leaf_n texts of the leaf, tokens, masked)."""
    tokens = varied.select("own", "leaf", "n", "leaf_n", "tokens", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("shared")).filter(F.col("shared") >= least).select(F.col("leaf").alias("l"), F.col("at").alias("p"), F.col("token").alias("t"), "shared")
    held = tokens.join(common, (F.col("leaf") == F.col("l")) & (F.col("at") == F.col("p")) & (F.col("token") == F.col("t")))
    wide = F.col("shared") >= SHARE * F.col("leaf_n")
    held = held.groupBy("own", "leaf", "tokens").agg(F.sort_array(F.collect_list(F.struct("at", "token", wide.alias("wide")))).alias("kept"))
    kept = F.array(F.transform("kept", lambda x: F.struct(x["at"], x["token"])), F.transform(F.filter("kept", lambda x: x["wide"]), lambda x: F.struct(x["at"], x["token"])))
    held = held.select("own", "leaf", "tokens", F.explode(F.array_distinct(kept)).alias("kept")).filter(F.size("kept") >= fixed * F.col("tokens"))
    return held.select(F.col("own").alias("of_own"), F.xxhash64("leaf", F.col("kept").cast("string")).alias("template"))


def template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, most: float = MOST_RECURRING, fixed: float = LEAST_FIXED) -> DataFrame:
    """(row_key, gone): the numbers of each text's lines, from 0, that recurring templates drop. Copies of a text count once."""
    rows = docs.select(content_key(text_col).alias("row_key"), F.col(text_col).alias("text")).filter(F.col("text") != "")
    lines = stage(rows.mapInArrow(_lines, "row_key binary, line int, tokens int, size int, leaf long, own long, masked string"), "lines")
    # Distinct lines with the number of texts that have each: made of distinct pairs, so that neither copies nor a hot line gather.
    each = lines.groupBy("own", "row_key").agg(F.any_value("leaf").alias("leaf"))
    distinct = stage(each.groupBy("own").agg(F.any_value("leaf").alias("leaf"), F.count("*").alias("n")), "distinct-lines")
    often = small(stage(distinct.filter(F.col("n") >= least).select(F.col("own").alias("of_own")), "often"))
    same = lines.join(often, F.col("own") == F.col("of_own"), "left_semi").select("row_key", "line", "tokens", "size", F.col("own").alias("template"))

    others = distinct.filter(F.col("n") < least)
    full = stage(others.groupBy("leaf").agg(F.sum("n").alias("leaf_n")).filter(F.col("leaf_n") >= least).withColumnRenamed("leaf", "of_leaf"), "leaves")
    varied = others.join(small(full), F.col("leaf") == F.col("of_leaf")).select("own", "n", "leaf_n")
    shown = lines.join(small(full.select("of_leaf")), F.col("leaf") == F.col("of_leaf"), "left_semi").groupBy(F.col("own").alias("of_own")).agg(*(F.any_value(c).alias(c) for c in ("leaf", "tokens", "masked")))
    varied = stage(varied.join(shown, F.col("own") == F.col("of_own")).drop("of_own"), "varied")
    general = small(stage(_generalised(varied, least, fixed), "general"))
    other = lines.join(general, F.col("own") == F.col("of_own")).select("row_key", "line", "tokens", "size", "template")

    marked = stage(same.union(other).distinct(), "marked")
    recurs = lambda rows: rows.select("template", "row_key").distinct().groupBy(F.col("template").alias("of_template")).agg(F.count("*").alias("texts")).filter(F.col("texts") >= least).select("of_template")
    marked = stage(marked.join(small(stage(recurs(marked), "candidates")), F.col("template") == F.col("of_template"), "left_semi"), "recurring")
    held = marked.select("row_key", "line", "tokens", "size").distinct().groupBy(F.col("row_key").alias("of_key")).agg(F.sum("tokens").alias("held"), F.any_value("size").alias("size"))
    counts = marked.join(held.filter(F.col("held") <= most * F.col("size")).select("of_key"), F.col("row_key") == F.col("of_key"), "left_semi")
    dropped = marked.join(small(stage(recurs(counts), "templates")), F.col("template") == F.col("of_template"), "left_semi")
    return dropped.groupBy("row_key").agg(F.collect_set("line").alias("gone"))


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, **rules) -> DataFrame:
    """All rows and columns, with the lines of recurring templates cut from the text, and the columns n_lines and n_dropped.

    A null text stays null and an empty one empty, with no lines. Repeated rows and copies of a text count once and are
    cut alike. Blank lines stay; of those of variable fields alone the same line must recur. Texts and lines of any length are judged whole; a text
    is held by one task. An empty table gives no rows. Columns of the same names are kept under theirs; the new ones then
    end in ``_``.
    """
    key, of_key, gone = (free_name(docs, x) for x in ("row_key", "of_key", "gone"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    found = stage(template_lines(docs, id_col, text_col, least, **rules).select(F.col("row_key").alias(of_key), F.col("gone").alias(gone)), "gone")
    rows = docs.withColumn(key, content_key(text_col)).join(found, F.col(key) == F.col(of_key), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    count = F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 0).otherwise(F.size(lines))
    return rows.select(*(text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns), count.cast("long").alias(n_lines), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_dropped))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    cut = drop_template_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
