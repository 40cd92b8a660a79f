"""Keyword detection and weak labels over recognised text.

Short keyword lists are tested word by word in the scan. Keyword tables of any size become automata
that find all keywords of a text in one pass over it, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, contains_any, normalize_text


def keyword_images(
    lines: DataFrame, key: str, words: Sequence[str], min_score: float, text: str = "text", score: str = "score", case_sensitive: bool = False
) -> DataFrame:
    """Distinct keys with a line at or above the score that contains a keyword.

    The keyword test runs in the scan; only matching keys reach the distinct.
    """
    plain = normalize_text(F.col(text), case_sensitive)
    return lines.where((F.col(score) >= min_score) & contains_any(plain, words, case_sensitive)).select(key).distinct()


def keyword_labels(
    docs: DataFrame, key: str, text: str, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> DataFrame:
    """One (key, keyword, label) row per keyword a text contains; repeats and conflicts are kept."""
    pairs = [(w, 1) for w in positive] + [(w, 0) for w in negative]
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains(F.col(text), F.lit(w)), F.struct(F.lit(w).alias("keyword"), F.lit(y).alias("label")))
                for w, y in pairs
            ]
        )
    )
    return docs.select(key, F.inline(hits))


AUTOMATON_CHARS = 1 << 24  # keyword characters a task's automaton may hold


def _shards(keywords: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Distinct (keyword, label) rows with ``_shard``, cut by hash so that a shard has about ``most`` characters."""
    known = keywords.where(F.col("keyword").isNotNull()).select("keyword", "label").distinct()
    chars = known.agg(F.sum(F.length("keyword") + 1)).first()[0] or 0
    shards = -(-chars // most)
    return known.withColumn("_shard", F.pmod(F.xxhash64("keyword"), F.lit(max(1, shards)))), shards


def table_keyword_labels(docs: DataFrame, key: str, text: str, keywords: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """One (key, keyword, label) row per row of a (keyword, label) table whose keyword a text contains.

    The table goes to the tasks as an automaton a shard; a shard holds about ``most`` characters, and
    a larger table takes one pass over the texts for each of its shards. A keyword with two labels gives
    both rows, the empty keyword is in every text, and a null text or keyword matches nothing.
    """
    known, shards = _shards(keywords, most)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    types = [rows.schema["_key"].dataType.simpleString(), known.schema["label"].dataType.simpleString()]
    schema = f"`{key}` {types[0]}, keyword string, label {types[1]}"
    found = None
    for shard in range(shards):
        listed = known.where(F.col("_shard") == shard).select("keyword", "label").toArrow()  # about ``most`` characters
        shared = docs.sparkSession.sparkContext.broadcast(listed.combine_chunks())

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            table = shared.value
            rows_of: dict[str, list[int]] = {}
            for i, word in enumerate(table.column("keyword").to_pylist()):
                rows_of.setdefault(word, []).append(i)
            always = rows_of.pop("", [])
            automaton = ahocorasick.Automaton()
            for word, numbers in rows_of.items():
                automaton.add_word(word, numbers)
            if rows_of:
                automaton.make_automaton()
            for batch in batches:
                owner, hit = [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    met = {id(numbers): numbers for _, numbers in automaton.iter(value)} if rows_of else {}
                    numbers = [*always, *(n for some in met.values() for n in some)]
                    owner += [i] * len(numbers)
                    hit += numbers
                picked = table.take(pa.array(hit, pa.int64())).combine_chunks()
                columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
                columns += [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in picked.columns]
                yield pa.RecordBatch.from_arrays(columns, [key, "keyword", "label"])

        part = rows.mapInArrow(work, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found


def table_keyword_images(
    lines: DataFrame, key: str, keywords: DataFrame, min_score: float, text: str = "text", score: str = "score", case_sensitive: bool = False,
    most: int = AUTOMATON_CHARS,
) -> DataFrame:
    """``keyword_images`` for a table with a ``keyword`` column: texts and keywords are normalised alike."""
    plain = normalize_text(F.col("keyword"), case_sensitive)
    words = keywords.select(plain.alias("keyword"), F.lit(1).alias("label")).where("keyword <> ''")
    read = lines.where(F.col(score) >= min_score).select(key, normalize_text(F.col(text), case_sensitive).alias("_plain"))
    return table_keyword_labels(read, key, "_plain", words, most).select(key).distinct()


def label_conflicts(labels: DataFrame, key: str) -> DataFrame:
    """Rows per key and whether both labels occur."""
    return labels.groupBy(key).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("label") == 1).alias("pos_hits"),
        (F.count_distinct("label") > 1).alias("conflict"),
    )
