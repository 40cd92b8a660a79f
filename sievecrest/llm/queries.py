"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecrest.llm import (
    alignment, bpe, fingerprints, langid, licenses, packing, phrases, ppm, rules, sharding, simhash, vocab, wordbpe, wrappers,
)
from sievecrest.llm.common import read_table
from sievecrest.session import scratch_path

N_SHARDS = 16


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 16 shards of near equal bytes through 4,096 virtual slots and a stored map."""
    units = sharding.record_units(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    path = scratch_path(spark, "slot-map")
    sharding.write_map(sharding.plan_map(spark, sharding.slot_stats(units), N_SHARDS), path)
    placed = sharding.place_rows(units, sharding.read_map(spark, path))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").cast("int").alias("map_version"),
    )


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return ppm.score_texts(docs, "doc_id", "text", ppm.held_out(F.col("doc_id")))


def document_tokenizer():
    """Ids of byte_bpe_50k.json: its rank file with its one special token."""
    return vocab.rank_file_tokenizer(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {vocab.END_OF_TEXT: 50256}
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, "doc_id", "text", document_tokenizer())


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the rejecting rule, which follows the measured order of the rules and so differs between runs."""
    return rules.rule_report(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").drop("rejected_by")


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op7_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url", "html")


def op8_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op9_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    training = langid.training_row(F.col("doc_id"))
    filters = langid.train_filters(docs.where(training), "text", "lang")
    found = langid.predict_languages(docs, filters, "doc_id", "text")
    return found.select("doc_id", (~langid.training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)


def op11_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_corpus(docs, "doc_id", "text", first, public_tokenizers.PATTERN, second)


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return wordbpe.round_trip_digests(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def op13_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "text", "lang")
    return phrases.collocations(docs, "text", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_virtual_slots": op1_virtual_slots,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_rule_cascade": op4_rule_cascade,
    "op5_bottom_k": op5_bottom_k,
    "op6_license_scan": op6_license_scan,
    "op7_wrapper_text": op7_wrapper_text,
    "op8_anchor_simhash": op8_anchor_simhash,
    "op9_bloom_language_id": op9_bloom_language_id,
    "op10_merge_replay": op10_merge_replay,
    "op11_identity_alignment": op11_identity_alignment,
    "op12_speculative_bpe": op12_speculative_bpe,
    "op13_prefix_free_phrases": op13_prefix_free_phrases,
}

ORACLE: dict[str, str] = {
    "op4_rule_cascade": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), p AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), again AS (
  SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + s) AS n FROM again, (VALUES (0), (1), (2)) AS v(s) GROUP BY r
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low,
    len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (r)
), v AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 10 * n_words,
    100 * up > 60 * (up + low), 100 * n_dup_lines > 50 * n_lines,
    word_chars < 2 * n_words OR word_chars > 14 * n_words] AS bad FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed,
  NOT list_bool_or(bad) AS kept FROM v
""",    "op13_prefix_free_phrases": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), w AS (
  SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM pieces
), f1 AS (
  SELECT lang, w AS phrase, count(*) AS f, 1 AS m FROM w GROUP BY ALL
), seen AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM w WINDOW o AS (PARTITION BY p ORDER BY i)
), f2 AS (SELECT lang, w || ' ' || w2 AS phrase, count(*) AS f, 2 AS m FROM seen WHERE w2 IS NOT NULL GROUP BY ALL
), f3 AS (SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f, 3 AS m FROM seen WHERE w3 IS NOT NULL GROUP BY ALL
), f4 AS (SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) AS f, 4 AS m
  FROM seen WHERE w4 IS NOT NULL GROUP BY ALL
), f5 AS (SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS phrase, count(*) AS f, 5 AS m
  FROM seen WHERE w5 IS NOT NULL GROUP BY ALL
), known AS (
  SELECT lang, phrase, f, m, string_split(phrase, ' ') AS ws FROM (
    FROM f1 UNION ALL FROM f2 UNION ALL FROM f3 UNION ALL FROM f4 UNION ALL FROM f5) WHERE f >= 100
), total AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM known, unnest(range(1, m)) AS u(k) WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = head JOIN known y ON y.lang = c.lang AND y.phrase = tail
  JOIN total t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, array_to_string(ws[i:j], ' ') AS part
    FROM known, (VALUES (1, 2), (2, 3), (3, 4), (4, 5), (1, 3), (2, 4), (3, 5), (1, 4), (2, 5)) AS v(i, j)
    WHERE j <= m AND j - i + 1 < m) GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score
FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase
WHERE g.f IS NULL OR 100 * g.f < 100 * a QUALIFY rank <= 2000
""",
}
