"""Quality rules by distance from language references (operator 3), with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import let, staged

SPACES = " \t\n\x0b\f\r"

# Frequent function words; each language's histogram has one bin for each word and one for the rest.
COMMON_WORDS = {
    "de": "der die das und in zu den ist von mit ein eine nicht auf für".split(),
    "en": "the of and to in a is that for it was on with as be by".split(),
    "es": "de la que el en y a los se del las un por con para una".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur".split(),
}

# Character classes as Java patterns; what none of them takes is the last bin.
CHARACTER_CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "space": r"[ \t-\r]",
    "stop": r"[.,;:!?]",
    "symbol": r"[#*$%&|<>]",
}


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; distances are Jensen-Shannon distances with base 2, from 0 to 1.

    A document is held against its language's references only with at least ``min_chars`` characters
    (character classes) or ``min_words`` words (common words).
    """

    least_words: int = 50
    most_repeated_percent: int = 50
    min_chars: int = 300
    min_words: int = 120
    char_distance: float = 0.25
    word_distance: float = 0.26


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Hash and position of each window share a long, so that one sort of longs brings equal windows
    together; neighbours count as equal only if their words are. The places that have an equal
    neighbour, in order, each add the part of their three words that the one before has not covered.
    """

    def places(w: Column, bits: Column) -> Column:
        low = F.expr("1L")
        window = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )

        def equal(a: Column, b: Column) -> Column:
            same = F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)
            mask = F.call_function("shiftleft", low, bits) - 1
            i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            return same & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def found(s: Column) -> Column:
            mask = F.call_function("shiftleft", low, bits) - 1
            hit = F.filter(s, lambda x, k: F.coalesce(equal(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(s, k + 1)), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(mask)))

        return let(F.sort_array(window), found)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(x - F.get(p, k - 1), F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def counted(w: Column) -> Column:
        bits = (F.floor(F.log2(F.size(w).cast("double"))) + 1).cast("int")
        return let(bits, lambda b: let(places(w, b), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, counted))


def text_counts(text: Column, lang: Column) -> dict[str, Column]:
    """Base counts of one text and its two histograms, from two passes of projections."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    common = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])(" + "|".join(listed) + r")(?![\p{L}\p{N}])"), F.lit(1))
    left = {f"c_{name}": F.length(F.regexp_replace(text, pattern + "+", "")) for name, pattern in CHARACTER_CLASSES.items()}
    return {"words": words, "lines": lines, "common": common, "n_characters": F.length(text).cast("long"), **left, "language": lang}


def document_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each document: ``keep``, the base counts, ``chars`` and ``common`` histograms.

    The histograms have one count for each bin; a language without a word list has one word bin.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit(""))
    parts = docs.select(*keep, text.alias("_text"), lang.alias("_lang")).select("*", *[c.alias(f"_{n}") for n, c in text_counts(F.col("_text"), F.col("_lang")).items()])
    lists = F.lit(None).cast("array<string>")
    for name, listed in COMMON_WORDS.items():
        lists = F.when(F.col("_lang") == name, F.array(*map(F.lit, listed))).otherwise(lists)
    classes = [(F.col("_n_characters") - F.col(f"_c_{name}")).cast("double") for name in CHARACTER_CLASSES]
    chars = F.array(*classes, F.col("_n_characters").cast("double") - sum(classes[1:], classes[0]))
    found = let(
        F.col("_common"),
        lambda m: F.transform(F.coalesce(lists, F.array().cast("array<string>")), lambda word: F.size(F.filter(m, lambda x: x == word)).cast("double")),
    )
    counted = parts.select(
        *keep,
        F.col("_lang").alias("language"),
        _size(F.col("_words")).alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.col("_n_characters") - F.col("_c_symbol")).cast("long").alias("n_symbols"),
        (_size(F.col("_lines")) - _size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        chars.alias("chars"),
        found.alias("found"),
    )
    total = F.aggregate("found", F.lit(0.0), lambda a, b: a + b)
    rest = F.greatest(F.col("n_words").cast("double") - total, F.lit(0.0))
    return counted.withColumn("common", F.concat("found", F.array(rest))).drop("found")


def _references(counts: DataFrame) -> DataFrame:
    """Total histograms of each language over all its documents."""
    n_chars, n_words = len(CHARACTER_CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    sums = {f"a{i}": F.sum(F.get("chars", F.lit(i))) for i in range(n_chars)} | {f"b{i}": F.sum(F.get("common", F.lit(i))) for i in range(n_words)}
    return counts.groupBy(F.col("language").alias("of_language")).agg(*[v.alias(k) for k, v in sums.items()]).select(
        "of_language",
        F.array(*[f"a{i}" for i in range(n_chars)]).alias("of_chars"),
        F.array(*[F.coalesce(f"b{i}", F.lit(0.0)) for i in range(n_words)]).alias("of_common"),
    )


def jensen_shannon(left: Column, right: Column) -> Column:
    """Distance of two histograms of counts, missing bins being 0; 0 if either is empty."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def divergence(l: Column, r: Column) -> Column:
        def bin_(x: Column, y: Column) -> Column:
            return let(
                F.struct((F.coalesce(x, F.lit(0.0)) / l).alias("p"), (F.coalesce(y, F.lit(0.0)) / r).alias("q")),
                lambda v: term(v["p"], (v["p"] + v["q"]) / 2) + term(v["q"], (v["p"] + v["q"]) / 2),
            )

        return F.sqrt(F.greatest(total(F.zip_with(left, right, bin_)) / 2, F.lit(0.0)))

    both = let(total(left), lambda l: let(total(right), lambda r: F.when((l > 0) & (r > 0), divergence(l, r))))
    return F.coalesce(both, F.lit(0.0))


def judged(counts: DataFrame, rules: QualityRules = QualityRules(), references: DataFrame | None = None) -> DataFrame:
    """Add base_failed, the two distances and kept.

    Without ``references`` ``counts`` is read twice, so stage it first.
    """
    known = F.broadcast(_references(counts) if references is None else references)  # one row for each language
    n = F.col("n_words")
    return (
        counts.join(known, counts["language"] == known["of_language"], "left")
        .withColumn("base_failed", (n < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_percent * n))
        .withColumn("char_distance", jensen_shannon(F.col("chars"), F.col("of_chars")))
        .withColumn("word_distance", jensen_shannon(F.col("common"), F.col("of_common")))
        .withColumn("char_failed", (F.col("word_chars") >= rules.min_chars) & (F.col("char_distance") > rules.char_distance))
        .withColumn("word_failed", (n >= rules.min_words) & (F.col("word_distance") > rules.word_distance))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("char_failed") & ~F.col("word_failed"))
    )


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts, distances and verdict of every document, from its whole text.

    A null or empty text has no words and fails the base rule. A null language is a language of its
    own; one without a word list is judged by characters alone. References are totals over all
    documents of the language, so repeated rows count each time. An empty table gives no rows.
    """
    counts = staged(document_counts(docs.select("doc_id", "text", "lang"), ["doc_id"]))
    return judged(counts, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "char_failed", "word_failed"
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns whatever these are called.

    ``docs`` is read twice, first for the references alone: a row has its text in it, and a staged copy
    of all rows would lie on disk for as long as the application runs.
    """
    references = staged(_references(document_counts(docs, [])))
    row = F.struct(*docs.columns).alias("row")
    packed = docs.select(row, "text", "lang")
    return judged(document_counts(packed, ["row"]), rules, references).where("kept").select("row.*")
