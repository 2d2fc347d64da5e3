"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
and read again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.common import spread, stage, table
from curatrix.llm.decontaminate import drop_contaminated
from curatrix.llm.jaccard import drop_similar
from curatrix.llm.line_dedup import drop_template_lines
from curatrix.llm.packing import pack_documents
from curatrix.llm.quality import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that its rules reject go.

    Null and empty texts and those of fewer than ten words go; a null language is judged by the classes alone. Texts of any length are
    judged whole. Repeated rows stay or go together. An empty table gives no rows. All columns stay, whatever their names.
    """
    return drop_low_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines of recurring templates go from the texts; every document stays. n_chars follows the text.

    A null text stays null (and n_chars with it), an empty one empty. Copies count once and are cut alike; a text all of whose lines
    recur in others with text of their own is left empty. Texts of any length are read whole. An empty table gives no rows. Columns
    whose names clash with the operator's own are kept.
    """
    cut = drop_template_lines(docs).drop("n_lines", "n_dropped") if not {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns} else drop_template_lines(docs)
    return cut.selectExpr(*("cast(length(text) as bigint) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs of a Jaccard similarity of 0.8 or more on five-word shingles connect, one document stays, that of the
    least id (ties: the least content key).

    Null and empty texts and those without words are one group. Of repeated rows one stays; rows without an id go only for one with an
    id, or all but one of their own. Texts of any length are read whole. An empty table gives no rows. All columns stay.
    """
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents contaminated by the benchmark go.

    Null and empty texts are never contaminated. Texts and items of any length are read whole. Repeated rows stay or go together. An empty
    table gives no rows, an empty benchmark removes none. All columns stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a row for each piece of a document and its place in a sequence.

    A null or empty text is its end id alone. Texts of any length are cut into pieces. Repeated rows and rows without an id each keep
    their own pieces. An empty table gives no rows. Columns but the id and the text are left out.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]
#: Sets of shingles, trees of lines and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
