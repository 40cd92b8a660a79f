"""Quality rules as a short-circuit cascade.

A rule is a predicate on lazily computed features of one text. On a bounded sample
(``SAMPLE_ROWS`` rows, a parameter) every rule is timed and its rejections are counted, on the
executors; only two short arrays a row come back. The rules are then ordered by rejections per second of
cost, and each text runs down that list until one rejects it. A text is kept if no rule rejects it,
so the order changes the cost and never the verdict.

Nulls and ties: a null text is an empty one and fails ``too_few_words``; an empty table gives no
rows and the rules' given order; equal rows get equal verdicts; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import SPACE_CHARS, small_batches, text_bytes

SAMPLE_ROWS = 1000
SYMBOLS = "#*$%&|<>"

# Cut-offs of the rules; plain parameters.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PERCENT = 10
MAX_UPPER_PERCENT = 60
MAX_DUP_LINE_PERCENT = 50
MEAN_WORD_CHARS = (2, 14)


class Features:
    """What the rules ask about one text; each value is computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        chars = len(self.text.decode("utf-8", "replace"))
        return chars - sum(self.text.count(c.encode()) for c in SPACE_CHARS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c.encode()) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window found at least twice."""
        words = self.words
        if len(words) < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        _, where, found = np.unique(windows, return_inverse=True, return_counts=True)
        again = found[where] > 1
        covered = np.zeros(len(words), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def upper_lower(self) -> tuple[int, int]:
        raw = np.frombuffer(self.text, np.uint8)
        return int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())


RULES: dict[str, Callable[[Features], bool]] = {
    "too_few_words": lambda f: f.n_words < MIN_WORDS,
    "repeated_windows": lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words,
    "many_symbols": lambda f: 100 * f.n_symbols > MAX_SYMBOLS_PERCENT * f.n_words,
    "upper_case": lambda f: 100 * f.upper_lower[0] > MAX_UPPER_PERCENT * sum(f.upper_lower),
    "repeated_lines": lambda f: 100 * f.n_dup_lines > MAX_DUP_LINE_PERCENT * len(f.lines),
    "word_length": lambda f: not MEAN_WORD_CHARS[0] * f.n_words <= f.word_chars <= MEAN_WORD_CHARS[1] * f.n_words,
}
BASE = ("too_few_words", "repeated_windows")


def measure_rules(df: DataFrame, text_col: str) -> DataFrame:
    """(seconds, rejected) of every rule, as two arrays a text; the texts stay on the executors."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, rejected = [], []
            for text in text_bytes(batch.column(0)):
                seconds, hits = [], []
                for rule in RULES.values():
                    features = Features(text)  # a rule pays for all it asks
                    began = time.perf_counter()
                    hits.append(rule(features))
                    seconds.append(time.perf_counter() - began)
                spent.append(seconds)
                rejected.append(hits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spent, pa.list_(pa.float64())), pa.array(rejected, pa.list_(pa.bool_()))], ["seconds", "rejected"]
            )

    return small_batches(df).select(F.col(text_col).alias("text")).mapInArrow(measure, "seconds array<double>, rejected array<boolean>")


def order_rules(df: DataFrame, text_col: str, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on the first ``sample_rows`` texts that Spark meets, best first.

    ``take`` runs one partition and further ones only while rows are missing; a row is two short arrays.
    """
    seen = measure_rules(df, text_col).take(sample_rows)
    gain = {
        name: sum(r["rejected"][i] for r in seen) / max(sum(r["seconds"][i] for r in seen), 1e-9) for i, name in enumerate(RULES)
    }
    return sorted(RULES, key=lambda name: -gain[name])


def rejecting_rule(features: Features, order: list[str]) -> str | None:
    """The first rule of the cascade that rejects; later ones are not evaluated."""
    return next((name for name in order if RULES[name](features)), None)


def apply_rules(df: DataFrame, text_col: str, order: list[str] | None = None) -> DataFrame:
    """The rows that pass every rule, with their columns as they are."""
    order = order or order_rules(df, text_col)
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [rejecting_rule(Features(t), order) is None for t in text_bytes(batch.column(at))]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return small_batches(df).mapInArrow(keep, df.schema)


def rule_report(df: DataFrame, id_col: str, text_col: str, order: list[str] | None = None) -> DataFrame:
    """Per text: the counts behind the base rules, the verdict and the rule that rejected it."""
    order = order or order_rules(df, text_col)
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Features(t) for t in text_bytes(batch.column(1))]
            by = [rejecting_rule(f, order) for f in found]
            columns = [pa.array([getattr(f, n) for f in found], pa.int64()) for n in names]
            failed = pa.array([any(RULES[r](f) for r in BASE) for f in found], pa.bool_())
            kept = pa.array([r is None for r in by], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, failed, kept, pa.array(by, pa.string())],
                ["doc_id", *names, "base_failed", "kept", "rejected_by"],
            )

    return rows.mapInArrow(report, f"doc_id {id_type}, {counts}, base_failed boolean, kept boolean, rejected_by string")
