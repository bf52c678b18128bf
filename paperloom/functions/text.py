"""Text columns: trimming, classification of lines, escaping, error rates and similarities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A heading's most bytes; a page's least characters for its text to be enough.
HEADING_BYTES, ENOUGH_CHARACTERS = 160, 80


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends; Spark's trim takes spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized_native_text(text: Column) -> Column:
    """Without NUL, trimmed."""
    return trimmed(F.replace(text, F.lit("\0"), F.lit("")))


def quality_characters(text: Column) -> Column:
    """How many characters are no white space."""
    return F.char_length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")


def is_heading(line: Column) -> Column:
    return (F.octet_length(line) <= HEADING_BYTES) & line.rlike(r"\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_list_item(line: Column) -> Column:
    return line.rlike("^([-*•] |[0-9]+[.)] )")


def block_kind(text: Column) -> Column:
    return F.when(is_heading(text), "heading").when(is_list_item(text), "list_item").otherwise("paragraph")


def escaped_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def error_rate(distance: Column, length: Column) -> Column:
    """Errors for each unit of truth; over 1 if there are more errors than units."""
    return distance / F.greatest(length, F.lit(1))


def similarity_from_error(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - rate)


def sequence_similarity(distance: Column, left: Column, right: Column) -> Column:
    return F.lit(1.0) - distance / F.greatest(left, right, F.lit(1))


def dimension_similarity(left: Column, right: Column) -> Column:
    """Smaller over larger; two of size 0 are alike."""
    return F.when(F.greatest(left, right) == 0, 1.0).otherwise(F.least(left, right) / F.greatest(left, right))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)


def distance_of_lists(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays of strings, such as words, by JVM expressions only.

    The dynamic programme keeps one row as an array and folds the other side over it.
    """
    start = F.sequence(F.lit(0), F.size(left))

    def next_row(row: Column, item: Column) -> Column:
        first = F.array(F.element_at(row, 1) + 1)
        cells = F.arrays_zip(left.alias("item"), F.slice(row, 1, F.size(left)).alias("diagonal"), F.slice(row, 2, F.size(left)).alias("above"))
        return F.aggregate(
            cells,
            first,
            lambda done, cell: F.concat(done, F.array(F.least(F.element_at(done, -1) + 1, cell["above"] + 1, cell["diagonal"] + F.when(cell["item"] == item, 0).otherwise(1)))),
        )

    return F.element_at(F.aggregate(right, start, next_row), -1)


@F.pandas_udf(T.StringType())
def normalized_text(text: pd.Series) -> pd.Series:
    """NFKC with runs of Unicode white space as one space, none at the ends; no built-in normalises."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def latex_tokens(text: pd.Series) -> pd.Series:
    """Commands, runs of letters and digits, and other signs; white space and braces part them."""

    def tokens(t: str | None) -> list[str] | None:
        if t is None:
            return None
        out, run = [], ""
        for sign in unicodedata.normalize("NFKC", t):
            if sign.isalnum():
                run += sign
                continue
            if run:
                out.append(run)
            run = ""
            if sign == "\\":
                run = sign
            elif not sign.isspace() and sign not in "{}":
                out.append(sign)
        return [*out, run] if run else out

    return text.map(tokens)
