"""Sinks: prediction and manifest tables, id lists, JSON summaries and the feature cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column orders of the exchanged CSV files.
PREDICTION_COLUMNS = ("id", "label")
PROBABILITY_COLUMNS = ("id", "prob_pos", "prob_pos_corrected", "label")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column] = (), single_file: bool = False) -> None:
    """CSV with a fixed column order, in parallel parts.

    ``order`` sorts globally (part files follow the order). ``single_file`` is for small exports only.
    """
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("errorifexists").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str, partition: str | None = "source") -> None:
    """Parquet manifest, partitioned so that source filters prune folders."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_candidates(df: DataFrame, path: str, name: str = "rule") -> None:
    """Long candidate predictions, one folder per rule."""
    df.write.mode("errorifexists").option("header", True).partitionBy(name).csv(path)


def write_id_list(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(F.col(id_col).cast("string")).write.mode("errorifexists").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON object; more rows than one are an error, none of them is dropped."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("a summary has one row")
    df.coalesce(1).write.mode("errorifexists").json(path)


def json_summary(df: DataFrame, name: str = "summary") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def cached_features(
    spark: SparkSession, cache: str, samples: DataFrame, backbone: str, compute: Callable[[DataFrame], DataFrame], key: str = "sample_id"
) -> DataFrame:
    """Features of ``samples`` for one backbone: read what the cache holds, compute and add the rest.

    The cache is Parquet partitioned by backbone; only ids it lacks (a left-anti join) are computed,
    and each call appends its own files.
    """
    try:
        stored = spark.read.parquet(cache).where(F.col("backbone") == backbone).drop("backbone")
        todo = samples.join(stored.select(key), key, "left_anti")
    except Exception as e:  # the cache does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = samples
    made = compute(todo).withColumn("backbone", F.lit(backbone))
    made.write.mode("append").partitionBy("backbone").parquet(cache)
    full = spark.read.parquet(cache).where(F.col("backbone") == backbone).drop("backbone")
    return full.join(samples.select(key), key, "left_semi")
