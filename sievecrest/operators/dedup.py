"""First-wins removal of exact and near duplicate images.

Two rows are compared when they share a 16-bit chunk of the perceptual hash, or of the difference
hash, wherever the chunk sits. A row is dropped when a *kept* earlier row matches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.functions.hashing import chunks, hamming, pieces
from sievecrest.functions.vectors import correlation_distance
from sievecrest.operators.components import first_wins
from sievecrest.session import cut_lineage

# The distance limits of the two match rules.
COLOR_LIMIT = 10
STRICT_CORR = 0.08
LOOSE_CORR = 0.04


def exact_duplicates(df: DataFrame, idx: str = "idx", digest: str = "digest") -> DataFrame:
    """First row per digest: (digest, first_idx, copies). A min per digest combines map-side."""
    return df.groupBy(digest).agg(F.min(idx).alias("first_idx"), F.count(F.lit(1)).alias("copies"))


def _chunk_tables(p: str, d: str) -> Column:
    """Distinct (kind, chunk) keys of a row."""

    def tagged(kind: str, h: str) -> Column:
        return F.transform(F.array_distinct(chunks(F.col(h))), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("chunk")))

    return F.concat(tagged("p", p), tagged("d", d))


def shared_chunk_order(later_p: Column, later_d: Column, other_p: Column, other_d: Column, positional: bool = False) -> Column:
    """0..3: first shared chunk position of the later row's perceptual hash, 4..7: of its difference hash."""
    found = []
    for offset, mine, theirs in ((0, chunks(later_p), chunks(other_p)), (4, chunks(later_d), chunks(other_d))):
        for i in range(4):
            chunk = F.element_at(mine, i + 1)
            hit = (F.element_at(theirs, i + 1) == chunk) if positional else F.array_contains(theirs, chunk)
            found.append(F.when(hit, F.lit(offset + i)))
    return F.coalesce(*found)


def hamming_match(a: str, b: str, strict: int, loose: int) -> Column:
    """Hash part of both match rules."""
    p = hamming(F.col(f"{a}.phash"), F.col(f"{b}.phash"))
    d = hamming(F.col(f"{a}.dhash"), F.col(f"{b}.dhash"))
    ah = hamming(F.col(f"{a}.ahash"), F.col(f"{b}.ahash"))
    c = hamming(F.col(f"{a}.chash"), F.col(f"{b}.chash"))
    return ((p <= strict) & (d <= strict)) | ((p <= loose) & (d <= loose) & (ah <= loose) & (c <= COLOR_LIMIT))


def match_reason(p: Column, d: Column, a: Column, c: Column, corr: Column, strict: int = 4, loose: int = 8) -> Column:
    """Reason string of a near duplicate, NULL for no match; the strict rule is tried first."""
    text = F.format_string("%.4f", F.round(corr, 9) + 0.0)
    near = F.concat(F.lit("near_duplicate_phash="), p, F.lit(";dhash="), d, F.lit(";corr_dist="), text)
    combo = F.concat(
        F.lit("near_duplicate_hash_combo=phash:"), p, F.lit(",dhash:"), d, F.lit(",ahash:"), a, F.lit(",color:"), c,
        F.lit(";corr_dist="), text,
    )
    return F.when((p <= strict) & (d <= strict) & (corr <= STRICT_CORR), near).when(
        (p <= loose) & (d <= loose) & (a <= loose) & (c <= COLOR_LIMIT) & (corr <= LOOSE_CORR), combo
    )


HASHES = ("idx", "ahash", "dhash", "phash", "chash")


def hash_pairs(later: DataFrame, earlier: DataFrame, strict: int = 4, loose: int = 8, positional: bool = False, ordered: bool = True) -> DataFrame:
    """(later_idx, earlier_idx, ord): pairs that share a chunk and pass the hash part of a match rule.

    No chunk is joined on alone. Both rules need the two hashes within ``max(strict, loose)`` bits of
    each other, so two matching rows agree on one of that many slices plus one of the *other* hash;
    the join key is (chunk, slice number, slice), which cuts a chunk that many rows share without
    losing a pair. Every pair comes out once, at its first shared key. ``ordered=False`` also pairs a
    left row with right rows that come after it.
    """
    keys_of = _chunk_tables("phash", "dhash")
    cols = list(HASHES)
    parts = max(strict, loose) + 1

    def other_slices(h_p: Column, h_d: Column, kind: Column) -> Column:
        return F.when(kind == "p", pieces(h_d, parts)).otherwise(pieces(h_p, parts))

    def keyed(df: DataFrame) -> DataFrame:
        rows = df.select(*cols, F.explode(keys_of).alias("_k"))
        slices = other_slices(F.col("phash"), F.col("dhash"), F.col("_k.kind"))
        return rows.select(*cols, "_k", F.posexplode(slices).alias("_no", "_slice"))

    a, b = keyed(later).alias("a"), keyed(earlier).alias("b")
    order = shared_chunk_order(F.col("a.phash"), F.col("a.dhash"), F.col("b.phash"), F.col("b.dhash"), positional)
    mine = F.concat(chunks(F.col("a.phash")), chunks(F.col("a.dhash")))
    first_key = (F.when(order < 4, "p").otherwise("d") == F.col("a._k.kind")) & (
        F.element_at(mine, order + 1) == F.col("a._k.chunk")
    )
    equal = F.zip_with(
        other_slices(F.col("a.phash"), F.col("a.dhash"), F.col("a._k.kind")),
        other_slices(F.col("b.phash"), F.col("b.dhash"), F.col("a._k.kind")),
        lambda x, y: x == y,
    )
    first_slice = F.array_position(equal, True) == F.col("a._no") + 1
    in_order = F.col("a.idx") > F.col("b.idx") if ordered else F.col("a.idx") != F.col("b.idx")
    same_key = (F.col("a._k") == F.col("b._k")) & (F.col("a._no") == F.col("b._no")) & (F.col("a._slice") == F.col("b._slice"))
    return (
        a.join(b, same_key & in_order)
        .where(hamming_match("a", "b", strict, loose) & first_key & first_slice)
        .select(F.col("a.idx").alias("later_idx"), F.col("b.idx").alias("earlier_idx"), order.alias("ord"))
    )


def matched_pairs(pairs: DataFrame, rows: DataFrame, strict: int = 4, loose: int = 8) -> DataFrame:
    """Pairs that also pass the correlation part, with their reason; features join only here."""
    cols = [*HASHES, "feature"]
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    full = pairs.join(a, F.col("later_idx") == F.col("a_idx")).join(b, F.col("earlier_idx") == F.col("b_idx"))
    p, d, ah, c = (hamming(F.col(f"a_{h}"), F.col(f"b_{h}")) for h in ("phash", "dhash", "ahash", "chash"))
    corr = correlation_distance(F.col("a_feature"), F.col("b_feature"))
    return (
        full.withColumn("reason", match_reason(p, d, ah, c, corr, strict, loose))
        .where(F.col("reason").isNotNull())
        .select("later_idx", "earlier_idx", "ord", "reason")
    )


def _leader_round(rows: DataFrame, strict: int, loose: int) -> tuple[DataFrame, DataFrame]:
    """Rows no undecided earlier row shares a chunk with, and the rows those match.

    Each chunk has at most one such leader, so the star join is linear in the undecided rows even
    when one chunk holds a third of them.
    """
    keyed = rows.select("idx", F.explode(_chunk_tables("phash", "dhash")).alias("_k"))
    lowest = keyed.groupBy("_k").agg(F.min("idx").alias("_min"))
    tagged = keyed.join(lowest, "_k")
    leaders = tagged.groupBy("idx").agg(F.max(F.col("_min") < F.col("idx")).alias("_blocked")).where(~F.col("_blocked")).select("idx")
    star = (
        tagged.where(F.col("_min") < F.col("idx"))
        .select(F.col("idx").alias("later_idx"), F.col("_min").alias("earlier_idx"))
        .distinct()
        .join(leaders.select(F.col("idx").alias("earlier_idx")), "earlier_idx", "left_semi")
        .withColumn("ord", F.lit(0))
    )
    a = rows.select(*[F.col(c) for c in HASHES]).alias("a")
    b = rows.select(*[F.col(c) for c in HASHES]).alias("b")
    near = (
        star.join(a, F.col("later_idx") == F.col("a.idx"))
        .join(b, F.col("earlier_idx") == F.col("b.idx"))
        .where(hamming_match("a", "b", strict, loose))
        .select("later_idx", "earlier_idx", "ord")
    )
    gone = matched_pairs(near, rows, strict, loose).select(F.col("later_idx").alias("idx")).distinct()
    return leaders, gone


def resolve_first_wins(edges: DataFrame) -> DataFrame:
    """(idx,) of rows to drop: those with a kept earlier neighbour.

    ``edges`` are (later_idx, earlier_idx) matches. Components are settled one by one in order, all at
    once (``components.first_wins``); rounds grow with the logarithm of the longest chain.
    """
    return first_wins(edges.select(F.col("later_idx").alias("later"), F.col("earlier_idx").alias("earlier")))[0]


def deduplicate(
    df: DataFrame, strict: int = 4, loose: int = 8, positional: bool = False, leader_rounds: int = 1
) -> DataFrame:
    """Every row with ``status`` (kept or removed), ``duplicate_of`` (idx) and ``duplicate_reason``.

    ``df`` needs idx (processing order), digest, the four hashes and the feature vector. Equals the
    one-by-one loop: keep a row unless its digest was kept or a kept earlier candidate matches it. A
    row without a digest is nobody's exact copy. Leader rounds take large groups of near copies off
    first, in linear time; they do not change the result.
    """
    base = cut_lineage(df.select(*HASHES, "digest", "feature"))
    firsts = exact_duplicates(base.where(F.col("digest").isNotNull())).select("digest", F.col("first_idx").alias("_first"))
    tagged = base.select("idx", "digest").join(firsts, "digest", "left")
    tagged = cut_lineage(tagged.withColumn("_first", F.coalesce("_first", "idx")))
    reps = base.join(tagged.where(F.col("idx") == F.col("_first")).select("idx"), "idx", "left_semi")
    open_rows, dropped = reps, []
    for _ in range(0 if positional else leader_rounds):
        leaders, gone = _leader_round(open_rows, strict, loose)
        gone = cut_lineage(gone)
        dropped.append(gone)
        open_rows = cut_lineage(open_rows.join(leaders, "idx", "left_anti").join(gone, "idx", "left_anti"))
    edges = matched_pairs(hash_pairs(open_rows, open_rows, strict, loose, positional), open_rows, strict, loose)
    dropped.append(resolve_first_wins(edges))
    gone = dropped[0]
    for more in dropped[1:]:
        gone = gone.unionByName(more)
    gone = gone.distinct().withColumn("_gone", F.lit(True))
    # A copy of a kept row is an exact duplicate; a copy of a dropped row is dropped by the same match.
    state = tagged.join(gone.withColumnRenamed("idx", "_first"), "_first", "left")
    state = cut_lineage(state.withColumn("_gone", F.coalesce("_gone", F.lit(False))))
    is_first = F.col("idx") == F.col("_first")
    kept_rows = base.join(state.where(is_first & ~F.col("_gone")).select("idx"), "idx", "left_semi")
    lost_firsts = base.join(state.where(is_first & F.col("_gone")).select("idx"), "idx", "left_semi")
    # Compare each dropped image once; its copies then pick among its matches those before them.
    pairs = hash_pairs(lost_firsts, kept_rows, strict, loose, positional, ordered=False)
    matches = matched_pairs(pairs, base, strict, loose).withColumnRenamed("later_idx", "_first")
    first = (
        state.where(F.col("_gone")).select("idx", "_first").join(matches, "_first")
        .where(F.col("earlier_idx") < F.col("idx"))
        .groupBy("idx")
        .agg(F.min_by(F.struct("earlier_idx", "reason"), F.struct("ord", "earlier_idx")).alias("_m"))
    )
    out = state.join(first, "idx", "left")
    exact = ~F.col("_gone") & (F.col("idx") != F.col("_first"))
    return out.select(
        "idx",
        "digest",
        F.when(F.col("_gone") | exact, "removed").otherwise("kept").alias("status"),
        F.when(exact, F.col("_first")).otherwise(F.col("_m.earlier_idx")).alias("duplicate_of"),
        F.when(exact, F.lit("exact_sha256")).otherwise(F.col("_m.reason")).alias("duplicate_reason"),
    )


def dedup_manifest(decisions: DataFrame, meta: DataFrame) -> DataFrame:
    """Kept and removed rows with provenance; ratios printed with eight decimals."""
    names = meta.select(F.col("idx").alias("duplicate_of"), F.col("output_path").alias("_of"))
    return (
        decisions.join(meta, "idx")
        .join(names, "duplicate_of", "left")
        .select(
            "status", "category", "source_path", "output_path",
            F.coalesce("_of", F.lit("")).alias("duplicate_of"),
            F.coalesce("duplicate_reason", F.lit("")).alias("duplicate_reason"),
            F.format_string("%.8f", "bbox_area_ratio").alias("bbox_area_ratio"),
            F.format_string("%.8f", "foreground_ratio").alias("foreground_ratio"),
        )
    )


def status_counts(decisions: DataFrame, by: str = "category") -> DataFrame:
    return decisions.groupBy(by).agg(
        F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") == "removed").alias("removed")
    )
