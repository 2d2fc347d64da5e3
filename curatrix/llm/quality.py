"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram of character classes, and that of its language's most common words (with all other words as
the last bin), are compared to language references by Jensen-Shannon distance (base 2, so 0 to 1). Short documents say
too little for that and are judged by the base rules alone.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, spread, table

BLANKS = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
RUN = 5
#: Guard: shorter documents are not compared to the references.
COMPARED_WORDS = 60
MOST_CLASS_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.34

#: Character classes in the order in which they are counted; the rest is the last class.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", r"[0-9]+", r"""[.,;:!?'"()\-]+""", r"[#*$%&|<>]+")
#: Each language's shares of characters that are small letters, capitals, blanks, digits, common punctuation, symbols and
#: others, and its most common words with their shares of all words. Both are what ``fit_references`` gives for the 3,409 labelled documents of
#: good quality in the test tables (sf0.1), with these words as the vocabulary to choose from; for another corpus it makes others.
#: A language's words sum to so much that a text without any of them lies beyond MOST_WORD_DISTANCE (0.359 or more).
CLASS_SHARES = {
    "en": (0.7952, 0.0138, 0.1667, 0.0006, 0.0237, 0.0, 0.0),
    "fr": (0.7946, 0.0140, 0.1667, 0.0008, 0.0238, 0.0, 0.0),
    "de": (0.8103, 0.0128, 0.1546, 0.0004, 0.0218, 0.0, 0.0),
    "es": (0.8011, 0.0135, 0.1616, 0.0008, 0.0230, 0.0, 0.0),
}
COMMON_WORDS = {
    "en": {"the": 0.0553, "of": 0.0286, "and": 0.0232, "to": 0.0168, "a": 0.0138, "in": 0.0117, "is": 0.0105, "that": 0.0092, "it": 0.0079, "for": 0.0077, "was": 0.0068, "on": 0.0065,
           "with": 0.0058, "as": 0.0052, "be": 0.0048, "by": 0.0048, "this": 0.0045, "are": 0.0045, "at": 0.0041, "from": 0.0037},
    "fr": {"de": 0.0551, "la": 0.0300, "le": 0.0221, "et": 0.0169, "les": 0.0140, "des": 0.0118, "en": 0.0113, "un": 0.0095, "du": 0.0079, "une": 0.0072, "que": 0.0066, "pour": 0.0064,
           "est": 0.0062, "dans": 0.0051, "qui": 0.0050, "par": 0.0044, "au": 0.0044, "sur": 0.0043, "pas": 0.0043, "avec": 0.0039},
    "de": {"der": 0.0547, "die": 0.0287, "und": 0.0230, "in": 0.0167, "den": 0.0143, "von": 0.0116, "zu": 0.0099, "das": 0.0096, "mit": 0.0080, "sich": 0.0077, "des": 0.0067, "auf": 0.0065,
           "für": 0.0058, "ist": 0.0053, "im": 0.0049, "dem": 0.0047, "nicht": 0.0046, "eine": 0.0045, "ein": 0.0045, "als": 0.0036},
    "es": {"de": 0.0551, "la": 0.0288, "que": 0.0222, "el": 0.0165, "en": 0.0142, "y": 0.0114, "los": 0.0105, "se": 0.0090, "las": 0.0086, "del": 0.0076, "un": 0.0069, "por": 0.0068,
           "con": 0.0057, "no": 0.0055, "una": 0.0050, "su": 0.0048, "para": 0.0047, "al": 0.0044, "es": 0.0042, "lo": 0.0036},
}


@dataclasses.dataclass(frozen=True)
class References:
    """By language: shares of the character classes, and of the most common words."""

    classes: dict[str, tuple[float, ...]]
    words: dict[str, dict[str, float]]


REFERENCES = References(CLASS_SHARES, COMMON_WORDS)
#: Labelled documents that a fit reads at most (those of the least content hash); its result is a few numbers for each language.
MOST_LABELLED = 1_000_000
#: Languages that references have at most, those with the most labelled documents.
MOST_LANGUAGES = 200


def fit_references(docs: DataFrame, labels: DataFrame, good: Column | None = None, words: int = 20, vocabulary: dict[str, list[str]] | None = None, most_rows: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> References:
    """References by language from documents that labels call good, in DataFrame operations.

    labels: a row for each labelled document, with its id; good: a condition on them (``quality = 1`` unless given). A class's share is that of all
    characters of a language's good documents, a word's that of all their words, in small letters; both are rounded to four places. Words are runs
    between blanks that are letters throughout; vocabulary: those to choose from, by language, else any. Only ``most_rows`` documents are read where more
    are labelled. Null, empty and unlabelled texts and null languages say nothing; repeated rows count each. Without any good document there
    are no references.
    """
    labelled = labels.filter(F.expr("quality = 1") if good is None else good).select(F.col(id_col).alias("of_id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter((F.col("text") != "") & F.col("lang").isNotNull())
    rows = rows.join(labelled, F.col("id") == F.col("of_id"), "left_semi")
    rows = rows.orderBy(F.xxhash64("text", "id"), "id").limit(most_rows) if rows.count() > most_rows else rows
    languages = {r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    rows = rows.filter(F.col("lang").isin(sorted(languages)))

    left, counts = F.col("text"), []
    for kind in CLASSES:
        rest = F.regexp_replace(left, kind, "")
        counts.append(F.length(left) - F.length(rest))
        left = rest
    counts.append(F.length(left))
    sums = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), *(F.sum(c).alias(f"c{k}") for k, c in enumerate(counts)))
    classes = {r.lang: tuple(round(r[f"c{k}"] / r.chars, 4) for k in range(len(counts))) for r in sums.collect()}

    every = rows.select("lang", F.explode(F.split(F.lower("text"), BLANKS)).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = every.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("total"))
    chosen = every.filter(F.col("word").rlike(r"^\p{L}+$"))
    if vocabulary is not None:
        listed = [F.when(F.col("lang") == lang, F.col("word").isin(list(known))) for lang, known in vocabulary.items()]
        chosen = chosen.filter(F.coalesce(*listed, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = chosen.withColumn("rank", rank).filter(F.col("rank") <= words).join(total, F.col("lang") == F.col("of_lang")).orderBy("lang", "rank").collect()  # some words a language
    return References(classes, {lang: {r.word: round(r.n / r.total, 4) for r in top if r.lang == lang} for lang in sorted({r.lang for r in top})})


def class_references(references: References = REFERENCES) -> dict[str | None, list[float]]:
    """Each language's distribution over the classes, and under None the mean of all for any other language."""
    found = {k: [x / sum(v) for x in v] for k, v in references.classes.items()}
    return found | {None: [sum(x) / len(found) for x in zip(*found.values())] if found else None}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def _without(kind: str):
    def told(left: Column) -> Column:
        return F.struct(left["s"].alias("s"), F.concat(left["n"], F.array(F.length(left["s"]))).alias("n"))

    return lambda x: _bind(F.struct(F.regexp_replace(x["s"], kind, "").alias("s"), x["n"].alias("n")), told)


def _repeats(words: Column) -> Column:
    """Words that lie in runs of RUN words which occur twice or more in the text."""

    def counted(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(RUN), F.get(places, i + 1) - p), F.lit(RUN)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        def twice(ranked: Column) -> Column:
            kept = F.filter(ranked, lambda x, i: (F.get(ranked, i - 1)["h"] == x["h"]) | (F.get(ranked, i + 1)["h"] == x["h"]))
            return _bind(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(ranked, twice))

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - RUN)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(RUN))))
        return _bind(hashes, counted)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < RUN + 1, F.lit(0)).otherwise(_bind(hashed, runs)).cast("long")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions given as arrays of equal length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total / 2))


def _with_rest(shares: Column) -> Column:
    """The shares and, as the last bin, what is left of the whole."""
    rest = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda total, x: total + x)
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), rest)))


def judged(text: Column, lang: Column, references: References = REFERENCES) -> Column:
    """All figures and the verdict as one struct. Each costly value is bound once, so that a filter on the struct, which
    Spark pushes below projections, doesn't repeat it."""
    every = sorted({w for known in references.words.values() for w in known})
    listed, shares = F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>")
    for name, known in references.words.items():
        listed = F.when(lang == name, F.array(*map(F.lit, known))).otherwise(listed)
        shares = F.when(lang == name, F.array(*map(F.lit, known.values()))).otherwise(shares)
    every_class = class_references(references)
    mean = every_class.pop(None)
    reference = F.array(*map(F.lit, mean)) if mean else F.lit(None).cast("array<double>")
    for name, known in every_class.items():
        reference = F.when(lang == name, F.array(*map(F.lit, known))).otherwise(reference)
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    step = F.struct(text.alias("s"), F.array(F.length(text)).alias("n"))
    for kind in CLASSES:  # what a step removes is that class's count
        step = _bind(step, _without(kind))

    def measured(words: Column) -> Column:
        common = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(every))
        common = F.when((F.size(words) >= COMPARED_WORDS) & listed.isNotNull(), common)
        counts = _bind(common, lambda c: F.transform(listed, lambda w: F.size(c) - F.size(F.array_remove(c, w))))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), step["n"].alias("left"),
            _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _repeats(words).alias("n_repeat_words"), counts.alias("counts"),
        )

    def compared(m: Column) -> Column:
        n, left, size = m["n_words"], m["left"], len(CLASSES)
        classes = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda k: F.when(k < size, F.get(left, k) - F.coalesce(F.get(left, k + 1), F.lit(0))).otherwise(F.get(left, k)) / F.get(left, F.lit(0)))
        by_word = js_distance(_with_rest(F.transform(m["counts"], lambda c: c / n)), _with_rest(shares))
        failed = (n < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * n)
        return F.struct(
            *(m[k].alias(k) for k in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words")), (F.get(left, F.lit(size - 1)) - F.get(left, F.lit(size))).cast("long").alias("n_symbols"),
            F.when(n >= COMPARED_WORDS, js_distance(classes, reference)).alias("class_distance"), by_word.alias("word_distance"), failed.alias("base_failed"),
        )

    def verdict(r: Column) -> Column:
        close = (F.coalesce(r["class_distance"], F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce(r["word_distance"], F.lit(0.0)) <= MOST_WORD_DISTANCE)
        return F.struct(*(r[k].alias(k) for k in FIGURES[:-1]), (~r["base_failed"] & close).alias("kept"))

    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return _bind(_bind(_bind(words, measured), compared), verdict)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: References = REFERENCES) -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed and kept; no shuffle.

    A null or empty text has no words and fails. Documents with fewer than COMPARED_WORDS words have null distances;
    those of a null or unknown language a null word_distance and a class_distance from the languages' mean; a null distance never
    rejects; without any references all distances are null. Repeated rows are judged alike. Texts of any length are judged whole, inside one row's task. An empty table gives no rows. If ``docs`` has a column of such a name already, the new one ends in ``_``.
    """
    found = free_name(docs, "quality_figures")
    rows = docs.withColumn(found, _judged_row(docs, text_col, lang_col, references))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(found)[k].alias(free_name(docs, k)) for k in FIGURES))


def _judged_row(docs: DataFrame, text_col: str, lang_col: str, references: References) -> Column:
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    return judged(F.coalesce(F.col(text_col), F.lit("")), lang, references)


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: References = REFERENCES) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return docs.filter(_judged_row(docs, text_col, lang_col, references)["kept"])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same figures in DuckDB's SQL, made from the same fixed values."""
    chain, left = "t", ["length(t)"]
    for kind in CLASSES:
        quoted = kind.replace("'", "''")
        chain = f"regexp_replace({chain}, '{quoted}', '', 'g')"
        left.append(f"length({chain})")
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()) + " END"
    shares = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'{x}::DOUBLE' for x in v.values())}]" for k, v in COMMON_WORDS.items()) + " END"
    references = class_references()
    array = lambda xs: f"[{', '.join(f'{x!r}::DOUBLE' for x in xs)}]"
    classes = "CASE lang " + " ".join(f"WHEN '{k}' THEN {array(v)}" for k, v in references.items() if k) + f" ELSE {array(references[None])} END"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2))"
    rest = lambda x: f"list_append({x}, greatest(0, 1 - list_sum({x})))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, [{', '.join(left)}] AS l, {classes} AS classes, {listed} AS listed, {shares} AS shares, list_transform(w, lambda x: lower(x)) AS low FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
  list_transform(range(1, {len(CLASSES) + 2}), lambda k: (l[k] - coalesce(l[k + 1], 0)) * 1.0::DOUBLE / greatest(1, l[1])) AS p, list_transform(listed, lambda c: len(list_filter(low, lambda x: x = c)) * 1.0::DOUBLE / greatest(1, n_words)) AS q FROM m)
SELECT doc_id, n_words, word_chars, CAST(l[{len(CLASSES)}] - l[{len(CLASSES) + 1}] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {COMPARED_WORDS} OR ({js('p', 'classes')} <= {MOST_CLASS_DISTANCE} AND coalesce({js(rest('q'), rest('shares'))}, 0) <= {MOST_WORD_DISTANCE})) AS kept FROM f
"""
