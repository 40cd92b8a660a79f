"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

The sketch of a text is its ``K`` smallest distinct 64-bit hashes of five-word shingles. The sketch
of a union is the ``K`` smallest of both sketches, so parts of a document, or documents of a group,
merge without their texts. Two sketches estimate resemblance and containment, one the number of
distinct shingles; below ``K`` shingles all three are exact.

Nulls and ties: a null text is an empty one; a text of one to four words has one shingle, all of it;
a text without a word has an empty sketch, whose likeness is 1 to another empty one and 0 to others.
Equal texts have equal sketches. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.llm.common import WORD
from sievecrest.operators.ordering import global_row_number
from sievecrest.session import cut_lineage

K = 128
SHINGLE = 5
CHUNK_ROWS = 500
MAX_CHUNKS = 1 << 17
_SPAN = float(2**64)
_LOWEST = -float(2**63)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K) -> Column:
    """Ascending array of at most ``k`` hashes."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        rolling = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]),
        )
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= SHINGLE, rolling).when(F.size(w) > 0, whole).otherwise(none)

    return F.slice(F.sort_array(F.array_distinct(_once(words, hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index: the share of the union's sketch that lies in both."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))

    return _once(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    reach = (F.element_at(a, k).cast("double") - _LOWEST) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    shared = j * (na + nb) / (1 + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / na))


def encode(a: Column) -> Column:
    """Sketch as text: 16 lower-case hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch a group, for groups of any size: the k smallest hashes of salted parts, then of the parts."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    salted = hashes.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    for by in ([*keys, "_salt"], keys):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
        salted = salted.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
    merged = salted.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_merged"))
    on = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(keys)]
    named = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).distinct()
    empty = F.array().cast("array<bigint>")
    return named.join(merged, on, "left").select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], F.coalesce("_merged", empty).alias(sketch_col)
    )


def _in_order(b: Column, doc_id: Column, h: Column) -> Column:
    """Whether key ``b`` is at or before (doc_id, h): larger ids first, null ids last, then smaller hashes."""
    tie = b["doc_id"].eqNullSafe(doc_id) & (b["h"] <= h)
    return tie | F.coalesce(b["doc_id"] > doc_id, doc_id.isNull() & b["doc_id"].isNotNull())


def _chunk_of(bounds: Column, doc_id: Column, h: Column) -> Column:
    """How many chunk starts are at or before a key, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(17, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, width: F.when(
            (low + width <= F.size(bounds)) & _in_order(F.get(bounds, low + width - 1), doc_id, h), low + width
        ).otherwise(low),
    )


def with_next_text(df: DataFrame, id_col: str, text_col: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, text, sk, next_text, next_sk): every text beside that of the next smaller id.

    Rows equal in id follow in the order of text hashes, a repeated row is followed by its copy, and
    the last row by the first. The order is made of (id, hash) alone and cut into chunks of about
    ``chunk_rows`` rows, at most ``MAX_CHUNKS``. Texts move once, to their chunk; the first text of a
    chunk also goes to the one before it, to be the last row's next.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h")
    )
    keys = cut_lineage(rows.select("doc_id", "h").distinct())  # read again by the range partitioner
    order = cut_lineage(global_row_number(keys, [F.col("doc_id").desc_nulls_last(), F.col("h").asc()], "at"))
    size = max(chunk_rows, -(-order.count() // MAX_CHUNKS))
    starts = order.where((F.col("at") - 1) % size == 0)
    bounds = cut_lineage(starts.agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "h"))).alias("bounds"))).scalar()

    placed = rows.withColumn("_b", bounds)
    placed = placed.withColumn("chunk", _chunk_of(F.col("_b"), F.col("doc_id"), F.col("h")))
    start = F.get("_b", F.col("chunk") - 1)
    is_start = start["doc_id"].eqNullSafe(F.col("doc_id")) & (start["h"] == F.col("h"))
    wraps = F.col("chunk") == 1
    own = F.struct(F.col("chunk"), F.lit(False).alias("extra"), F.lit(False).alias("wrap"))
    before = F.struct(
        F.when(wraps, F.size("_b")).otherwise(F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("extra"), wraps.alias("wrap")
    )
    sent = placed.select("doc_id", "text", "h", F.explode(F.when(is_start, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.select("doc_id", "text", "h", "to.*").repartition(parts, "chunk").withColumn("sk", sketch(F.col("text")))
    follow = Window.partitionBy("chunk").orderBy("wrap", F.col("doc_id").desc_nulls_last(), F.col("h").asc(), "extra")
    return (
        met.select("doc_id", "text", "sk", "extra", F.lead("text").over(follow).alias("next_text"), F.lead("sk").over(follow).alias("next_sk"))
        .where(~F.col("extra"))
        .drop("extra")
    )


def fingerprint_edits(df: DataFrame, id_col: str, text_col: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sketch every text, and the text whose last third gives way to the start of the next one."""
    met = with_next_text(df, id_col, text_col, chunk_rows)
    take = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - take), F.substring("next_text", 1, take))
    both = _once(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), sketch(e).alias("sk")))
    done = met.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sk", "next_sk", both.alias("e"))
    return done.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        encode(F.col("sk")).alias("fingerprint"),
        encode(F.col("e.sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("e.sk")).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
        distinct_shingles(F.col("sk")).alias("distinct_shingles"),
        containment(F.col("sk"), F.col("e.sk")).alias("contained_in_edited"),
    )
