"""Text expressions: terms, templates, character grams, redaction, ordered rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a term.
IDENTIFIER = r"[a-z_][a-z_0-9]*(?:\.[a-z_][a-z_0-9]*)?"
HAN_RUN = r"[\u4e00-\u9fff]+"

# Template masks in the order they apply, after NFKC and lower case.
TEMPLATE_MASKS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "<date>"),
    (r"\d{4}\s*年\s*第?[一二三四1-4]\s*季度", "<quarter>"),
    (r"\d{4}\s*年\s*\d{1,2}\s*月", "<month>"),
    (r"\d{4}\s*年", "<year>"),
    (r"(?<![a-z_])\d+(?:\.\d+)?(?![a-z_])", "<number>"),
    (r"\b[a-z]{2}\s*州\b", "<state>"),
    (r"\s+", ""),
    # The engine's \w takes marks and joiners too and leaves out some numbers, so both are named.
    (r"[^\p{L}\p{N}_<>]", ""),
)
# Digits, white space and word borders of all scripts.
ALL_SCRIPTS = "(?U)"
# Texts that are normalized at once; it only bounds memory.
NFKC_ROWS = 64

# Redaction of local paths in error text.
WHITESPACE_RUN = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
FILE_URI = r"(?i)file:[^\s,;]+"
DRIVE_PATH = r"(?i)(?:[a-z]:\\|[a-z]:/)[^\s,;]+"
PATH_MASK = "<database-path>"
ERROR_TEXT_LIMIT = 500


def _adjacent(chars: Column, width: int) -> list[Column]:
    """Runs of 1, 2, ... ``width`` neighbouring characters.

    Neighbours come from zipping the array with itself shifted: linear in the text, where
    cutting substrings by position would walk the text again for each of them.
    """
    grams = [chars]
    for shift in range(1, width):
        grams.append(F.zip_with(grams[-1], F.slice(chars, F.lit(shift + 1), F.size(chars)), lambda a, b: F.concat(a, b)))
    return [grams[0], *[F.array_compact(g) for g in grams[1:]]]


def lexical_terms(text: Column | str) -> Column:
    """Distinct lower-case identifiers and adjacent Han character pairs of a text."""
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit(f"({IDENTIFIER})"), 1)
    runs = F.regexp_extract_all(lowered, F.lit(f"({HAN_RUN})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: _adjacent(F.split(r, ""), 2)[1]))
    return F.array_distinct(F.concat(words, pairs))


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC, the one text step Spark has no expression for; few texts of a batch are Python strings at once."""
    parts = [pa.array([], pa.string())]
    for at in range(0, len(text), NFKC_ROWS):
        parts.append(pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in text.slice(at, NFKC_ROWS).to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


def normalize_template(text: Column | str) -> Column:
    """The wording of a text with dates, numbers and state codes masked, spaces and punctuation gone.

    Only non-ASCII text can change under NFKC; the rest still passes through the same batch.
    """
    out = F.lower(nfkc(text))
    for pattern, mask in TEMPLATE_MASKS:
        out = F.regexp_replace(out, F.lit(ALL_SCRIPTS + pattern), F.lit(mask))
    return out


def redact(text: Column | str, limit: int = ERROR_TEXT_LIMIT) -> Column:
    """One line of error text without local paths, bounded after masking the whole text."""
    out = F.trim(F.regexp_replace(text, F.lit(WHITESPACE_RUN), F.lit(" ")))
    out = F.regexp_replace(out, F.lit(FILE_URI), F.lit(PATH_MASK))
    out = F.regexp_replace(out, F.lit(DRIVE_PATH), F.lit(PATH_MASK))
    return F.substring(out, 1, limit)


def squeezed(text: Column | str) -> Column:
    """Lower case, single spaces, no trailing semicolon: the identity of a repeated statement."""
    out = F.trim(F.regexp_replace(F.lower(text), F.lit(WHITESPACE_RUN), F.lit(" ")))
    return F.trim(F.regexp_replace(out, F.lit(r";$"), F.lit("")))
