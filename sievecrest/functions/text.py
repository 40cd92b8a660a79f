"""Recognised-text normalisation and keyword matching as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caption words that stand for label 1 and label 0.
POSITIVE_WORDS = ("陨石", "meteorite", "meteor")
NEGATIVE_WORDS = ("岩石",)


def normalize_text(text: Column, case_sensitive: bool = False) -> Column:
    """Drop white space and the separators | - _ / and backslash; lower-case unless told not to."""
    plain = F.regexp_replace(text, r"[\s|\-_/\\]+", "")
    return plain if case_sensitive else F.lower(plain)


def parse_keywords(raw: str) -> list[str]:
    """Comma list -> trimmed keywords; an empty list is an error."""
    words = [w.strip() for w in raw.split(",") if w.strip()]
    if not words:
        raise ValueError("keyword list is empty")
    return words


def contains_any(text: Column, words: Sequence[str], case_sensitive: bool = False) -> Column:
    """Whether the normalised text contains any normalised keyword."""
    import re

    plain = [re.sub(r"[\s|\-_/\\]+", "", w) for w in words]
    quoted = [rf"\Q{w if case_sensitive else w.lower()}\E" for w in plain if w]
    return text.rlike("|".join(quoted)) if quoted else F.lit(False)


def lines_to_text(lines: Column, min_score: float = 0.0) -> Column:
    """Trimmed non-empty lines at or above a score joined by newlines; NULL when none is left."""
    from sievecrest.operators.filters import keep_lines

    joined = F.array_join(F.transform(keep_lines(lines, min_score), lambda s: s["text"]), "\n")
    return F.when(F.trim(joined) != "", joined)


def bracketed(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))
