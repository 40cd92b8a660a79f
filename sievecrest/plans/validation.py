"""Build validation sets that look like the test source."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.functions import risk as R
from sievecrest.functions.vectors import l2_normalise
from sievecrest.operators import clusters as C
from sievecrest.operators import neighbours as N
from sievecrest.operators import splits as SP
from sievecrest.operators.labels import minmax_weight
from sievecrest.session import cut_lineage


def test_like_scores(
    manifest: DataFrame, fit_sources: Sequence[str], sources: Sequence[str], components: int = 64, clusters: int = 24, top_k: int = 10,
    exclude: str | None = None, find: Callable[[DataFrame, DataFrame, int], DataFrame] = N.cosine_knn,
) -> DataFrame:
    """Every row with its cluster, cluster test share, anchor similarities and test-like score.

    Standardise and project on the fit sources, normalise, then compare with the test anchors by
    neighbours, by the anchor centroid and by cluster. ``exclude`` names a flag of test rows that are no
    anchors. ``find`` is the neighbour search: exact by default, or ``approx_knn`` at some similarity for
    tables too large for it; rows without a neighbour then have likeness 0. The normalised features, the placed rows
    and the scored rows are each read by several consumers, so each is written once.
    """
    fit = manifest.where(F.col("source").isin(*fit_sources))
    moved = C.standardise(manifest, fit)
    moved = C.project(moved, moved.where(F.col("source").isin(*fit_sources)), components)
    features = cut_lineage(moved.withColumn("embedding", l2_normalise(F.col("embedding"))))
    anchors = features.where("source = 'test'")
    if exclude:
        anchors = anchors.where(~F.coalesce(F.col(exclude), F.lit(False)))
    like = N.test_likeness(find(features, anchors, top_k), top_k).withColumnRenamed("query_id", "sample_id")
    placed = C.kmeans_labels(features, features.where(F.col("source").isin(*fit_sources)), clusters)
    placed = cut_lineage(N.centroid_similarity(placed, anchors).drop("embedding").join(like, "sample_id", "left").na.fill(0.0, ["topk_mean", "topk_max"]))
    share = C.cluster_summary(placed, sources).select("cluster", F.col("test_fraction").alias("cluster_test_fraction"))
    scored = placed.join(share, "cluster").withColumn(
        "test_like_score", R.test_like_score(F.col("topk_mean"), F.col("centroid_cos"), F.col("cluster_test_fraction"))
    )
    return cut_lineage(scored)


def validation_sets(scored: DataFrame, candidates: Sequence[str], n: int) -> DataFrame:
    """Top, cluster-balanced and weighted validation sets as one table tagged ``kind``."""
    pool = scored.where(F.col("source").isin(*candidates) & F.col("label").isNotNull())
    top = SP.stratified_take(pool, "sample_id", "label", "test_like_score", n)
    spread = SP.cluster_stratified_take(pool, "sample_id", "label", "test_like_score", "cluster", "cluster_test_fraction", n)
    weighted = minmax_weight(pool, "test_like_score")
    return (
        top.withColumn("kind", F.lit("top"))
        .unionByName(spread.withColumn("kind", F.lit("cluster")))
        .unionByName(weighted.withColumn("kind", F.lit("weighted")), allowMissingColumns=True)
    )


def build_summary(scored: DataFrame, sets: DataFrame) -> DataFrame:
    """One row of counts and its JSON form."""
    rows = scored.agg(
        F.count(F.lit(1)).alias("feature_rows"), F.count_if(F.col("source") == "test").alias("anchor_rows"), F.count_distinct("cluster").alias("clusters")
    )
    kinds = sets.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    packed = kinds.agg(F.map_from_entries(F.collect_list(F.struct("kind", "n")))).scalar()
    out = rows.withColumn("set_rows", packed)
    return out.withColumn("summary", F.to_json(F.struct(*rows.columns, "set_rows")))
