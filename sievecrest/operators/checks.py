"""Data-contract checks. Each returns a small table of counts and at most a few sorted examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_range(name: str, value: float, low: float, high: float, open_ends: bool = False) -> float:
    ok = low < value < high if open_ends else low <= value <= high
    if not ok:
        raise ValueError(f"{name}={value} outside {'(' if open_ends else '['}{low}, {high}{')' if open_ends else ']'}")
    return value


def examples(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """One row: up to ``n`` smallest values joined by commas. The limit runs before the gather."""
    few = df.select(F.col(col).alias("_v")).orderBy("_v").limit(n)
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list("_v")), lambda x: x.cast("string")), ",").alias("x"))


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_report(df: DataFrame, id_col: str = "id", n: int = 5) -> DataFrame:
    dup = duplicate_ids(df, id_col)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn(
        "examples", examples(dup, id_col, n).scalar()
    )


def id_set_report(a: DataFrame, b: DataFrame, id_col: str = "id", n: int = 5) -> DataFrame:
    """Ids only in ``a`` (missing from b) and only in ``b`` (extra), with examples."""
    left = a.select(F.col(id_col)).distinct().withColumn("_a", F.lit(True))
    right = b.select(F.col(id_col)).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, id_col, "full_outer")
    missing = both.where(F.col("_b").isNull())
    extra = both.where(F.col("_a").isNull())
    return (
        both.agg(
            F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
            F.count_if(F.col("_b").isNull()).alias("missing"),
            F.count_if(F.col("_a").isNull()).alias("extra"),
        )
        .withColumn("missing_examples", examples(missing, id_col, n).scalar())
        .withColumn("extra_examples", examples(extra, id_col, n).scalar())
    )


def complete_join_report(base: DataFrame, other: DataFrame, id_col: str = "id") -> DataFrame:
    """Row counts of a base table and of its inner join; ``complete`` when none was lost."""
    hit = other.groupBy(id_col).agg(F.count(F.lit(1)).alias("_m"))
    joined = base.select(id_col).join(hit, id_col, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("base_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("joined_rows")
    ).withColumn("complete", F.col("base_rows") == F.col("joined_rows"))


def label_report(df: DataFrame, label: str, known: Sequence[int] = (0, 1)) -> DataFrame:
    value = F.col(label)
    return df.agg(
        F.count_distinct(label).alias("classes"),
        F.count_if(value.isNull()).alias("missing_labels"),
        F.count_if(value.isNotNull() & ~value.isin(*known)).alias("unknown_labels"),
        *[F.count_if(value == k).alias(f"label_{k}") for k in known],
    ).withColumn(
        "usable",
        (F.col("unknown_labels") == 0) & (F.least(*[F.col(f"label_{k}") for k in known]) > 0)
        if len(known) > 1
        else F.col("unknown_labels") == 0,
    )


def missing_assets(df: DataFrame, assets: DataFrame, key: str, n: int = 5) -> DataFrame:
    lost = df.join(assets.select(key).distinct(), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("missing")).withColumn("examples", examples(lost, key, n).scalar())


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def fail_unless(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows pass through; the job fails on the first row that breaks the condition."""
    return df.where(F.assert_true(condition, F.lit(message)).isNull())
