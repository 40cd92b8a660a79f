"""Assemble the train, threshold-search and model-selection tables of one training run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.operators import checks as K
from sievecrest.operators import splits as SP
from sievecrest.operators.filters import pseudo_labels, skip_ids
from sievecrest.operators.labels import with_label_index
from sievecrest.operators.metrics import class_priors
from sievecrest.session import cut_lineage


def split_protocol(
    labels: DataFrame,
    *,
    seed: int,
    skips: DataFrame | None = None,
    masked: DataFrame | None = None,
    sample_ratio: float = 1.0,
    extra: DataFrame | None = None,
    extra_weight: float = 1.0,
    extra_val_ratio: float = 0.0,
    extra_by_group: bool = True,
    val: DataFrame | None = None,
    val_ratio: float = 0.0,
    pseudo: DataFrame | None = None,
    pseudo_threshold: float = 0.95,
    pseudo_weight: float = 0.5,
    search_ratio: float = 0.5,
    target_ratio: float | None = None,
) -> DataFrame:
    """One table (id, label, label_idx, sample_weight, source, role) of a run's splits.

    Order of steps: skip listed ids, index labels, sample, keep masked rows, add or group-split the
    extra source, choose the validation rows (extra split, train split or a given table), add pseudo
    labels, split validation into search and selection, rebalance both. Roles: train,
    threshold_search, model_select. ``extra`` carries id, label and group. Each ranked step reads its
    input twice, so a step's narrow (id, label) result is written before the next one ranks it.
    """
    base = K.require_columns(labels, ["id", "label"]).select(F.col("id").cast("string").alias("id"), "label")
    if skips is not None:
        base = skip_ids(base, skips.select(F.col("id").cast("string").alias("id")))
    base = with_label_index(base, "label")
    if sample_ratio < 1.0:
        base = cut_lineage(SP.sample_fraction(base, "id", sample_ratio, seed))
    if masked is not None:
        base = base.join(masked.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    train = base.withColumn("sample_weight", F.lit(1.0)).withColumn("source", F.lit("train"))
    held = None
    if extra is not None:
        more = extra.select(F.col("id").cast("string").alias("id"), "label", "group", F.col("label").alias("label_idx"))
        more = more.withColumn("sample_weight", F.lit(float(extra_weight))).withColumn("source", F.lit("extra"))
        if extra_val_ratio > 0.0:
            if extra_by_group:
                more = SP.stratified_group_split(more, "label_idx", "group", extra_val_ratio, seed + 11)
            else:
                more = SP.stratified_split(more, "id", "label_idx", extra_val_ratio, seed + 11)
            more = cut_lineage(more)
            held = more.where("role = 'val'").drop("role", "group")
            more = more.where("role = 'train'").drop("role")
        train = train.unionByName(more.drop("group"))
    if val_ratio > 0.0:
        parts = cut_lineage(SP.stratified_split(train, "id", "label_idx", val_ratio, seed + 3))
        train, held = parts.where("role = 'train'").drop("role"), parts.where("role = 'val'").drop("role")
    if extra_val_ratio <= 0.0 and pseudo is not None:
        rows = pseudo_labels(pseudo, pseudo_threshold).select(
            F.col("id").cast("string").alias("id"), "label", "label_idx", F.lit(float(pseudo_weight)).alias("sample_weight"), "source"
        )
        train = train.unionByName(rows)
    if held is None:
        if val is None:
            raise ValueError("no validation rows: give val, val_ratio or extra_val_ratio")
        held = val.select(F.col("id").cast("string").alias("id"), "label", F.col("label").alias("label_idx"), F.lit(1.0).alias("sample_weight"), F.lit("val").alias("source"))
    parts = cut_lineage(SP.stratified_subsplit(held, "id", "label_idx", search_ratio, seed + 7))
    search = parts.where("role = 'threshold_search'")
    select = parts.where("role = 'model_select'")
    if target_ratio is not None:
        search = SP.rebalance_to_ratio(search, "id", "label_idx", target_ratio, seed + 17)
        select = SP.rebalance_to_ratio(select, "id", "label_idx", target_ratio, seed + 29)
    return train.withColumn("role", F.lit("train")).unionByName(search).unionByName(select)


def protocol_priors(splits: DataFrame) -> DataFrame:
    """Class counts and priors of every role."""
    return class_priors(splits, "label_idx", by=["role"])
