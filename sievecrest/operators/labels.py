"""Label maps, asset flags and sample weights over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.functions.risk import range_weight


def with_label_index(df: DataFrame, label: str, expected: int | None = 2, name: str = "label_idx") -> DataFrame:
    """Dense index of sorted distinct labels; fails unless there are ``expected`` of them.

    The window runs over the distinct labels only, which then join back by value.
    """
    values = df.select(label).where(F.col(label).isNotNull()).distinct()
    index = values.withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    if expected is not None:
        ok = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) == expected, F.lit(f"expected {expected} classes"))
        index = index.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")
    return df.join(index, label, "left")


def asset_flags(df: DataFrame, path: str, marker: str) -> DataFrame:
    """``has_image`` and ``mask_status`` (mask, nomask or missing) from a path and a marker column."""
    has = F.length(F.coalesce(F.col(path), F.lit(""))) > 0
    return df.withColumn("has_image", has).withColumn(
        "mask_status", F.when(has, "mask").when(F.col(marker), "nomask").otherwise("missing")
    )


def minmax_weight(df: DataFrame, score: str, name: str = "sample_weight") -> DataFrame:
    """0.25..1.0 by position of a score in its own range; one scalar pass for the range."""
    span = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    return df.withColumn("_span", span).withColumn(name, range_weight(F.col(score), F.col("_span.lo"), F.col("_span.hi"))).drop("_span")
