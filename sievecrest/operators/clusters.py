"""Standardisation, projection, clustering and cluster summaries of embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.operators.batched import kmeans_together, nearest_centre
from sievecrest.session import cut_lineage


def vector_moments(df: DataFrame, vector: str = "embedding") -> Column:
    """Scalar struct(mean, std) of a vector column; std is the population deviation."""
    v = array_to_vector(F.col(vector))
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count")
    mean, var = vector_to_array("s.mean"), vector_to_array("s.variance")
    shrink = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return stats.select(F.struct(mean.alias("mean"), F.transform(var, lambda x: F.sqrt(x * shrink)).alias("std"))).scalar()


def standardise(df: DataFrame, fit_on: DataFrame, vector: str = "embedding") -> DataFrame:
    """Centre and scale all rows with the moments of a subset; constant positions become 0."""
    out = df.withColumn("_m", vector_moments(fit_on, vector))
    centred = F.zip_with(F.col(vector), F.col("_m.mean"), lambda x, m: x - m)
    return out.withColumn(vector, F.zip_with(centred, F.col("_m.std"), lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))).drop("_m")


def project(df: DataFrame, fit_on: DataFrame, components: int, vector: str = "embedding") -> DataFrame:
    """PCA fitted on a subset and applied to all rows; a no-op when nothing would be dropped.

    Fit on standardised rows: the transform does not centre.
    """
    dims = df.select(F.size(vector)).first()[0]
    k = min(components, dims, fit_on.count())
    if k >= dims:
        return df
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(fit_on.select(array_to_vector(F.col(vector)).alias("_v")))
    moved = model.transform(df.withColumn("_v", array_to_vector(F.col(vector))))
    return moved.withColumn(vector, vector_to_array("_p")).drop("_v", "_p")


def kmeans_labels(
    df: DataFrame, fit_on: DataFrame, k: int, seeds: Sequence[int] = tuple(range(42, 52)), vector: str = "embedding", name: str = "cluster", max_iter: int = 50
) -> DataFrame:
    """Cluster of every row; the run with the lowest training cost over several seeds is used.

    All runs share their passes over the rows (``batched.kmeans_together``).
    """
    train = cut_lineage(fit_on.select(F.col(vector).cast("array<double>").alias("_v")))
    k = max(2, min(k, train.count()))
    centres, _, _ = kmeans_together(train, k, seeds, max_iter)
    return df.withColumn(name, nearest_centre(centres, F.col(vector).cast("array<double>")))


def cluster_summary(
    df: DataFrame, sources: Sequence[str], cluster: str = "cluster", topk: str = "topk_mean", test_source: str = "test"
) -> DataFrame:
    """Sizes per source, label counts, mean test-likeness and the test share of every cluster."""
    out = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("source") == s).alias(f"{s}_count") for s in sources],
        F.count_if(F.col("label") == 1).alias("pos_count"),
        F.count_if(F.col("label") == 0).alias("neg_count"),
        F.avg(topk).alias("mean_topk"),
    )
    return out.withColumn("test_fraction", F.col(f"{test_source}_count") / F.col("total"))


def cluster_label_stats(df: DataFrame, label: str = "cluster", noise: int = -1) -> DataFrame:
    """Rows, clusters, noise share and sizes of any cluster labelling; the noise label is no cluster."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(label) != noise
    return sizes.agg(
        F.sum("n").alias("n_samples"),
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.max(F.when(real, F.col("n"))).alias("largest"),
    ).withColumn("noise_ratio", F.col("n_noise") / F.col("n_samples"))


def cluster_sizes(df: DataFrame, label: str = "cluster", noise: int = -1) -> DataFrame:
    return df.where(F.col(label) != noise).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
