"""Manifest assembly and candidate manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_candidates(conflicts: DataFrame, keep: Column) -> DataFrame:
    """Selected audit rows with the base sample weight ``0.25 + 0.75 * test share``."""
    return conflicts.where(keep).select(
        F.col("query_id").alias("sample_id"),
        F.col("query_label").alias("label"),
        "conflict_score",
        (0.25 + 0.75 * F.col("top10_test_frac")).alias("sample_weight"),
    )


def assemble_manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of heterogeneous sources (image_id, label, path, mask_status, ...) with sample ids.

    Missing columns become NULL, flags become false, labels stay NULL where unknown.
    """
    out = None
    for source, df in parts.items():
        tagged = df.withColumn("source", F.lit(source)).withColumn("sample_id", F.concat(F.lit(f"{source}/"), F.col("image_id").cast("string")))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    for c, default in (("is_not_stone", F.lit(False)), ("path", F.lit(""))):
        out = out.withColumn(c, F.coalesce(F.col(c), default) if c in out.columns else default)
    return out.withColumn("has_image", F.length("path") > 0)
