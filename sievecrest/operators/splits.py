"""Deterministic splits, folds, samples and rebalancing in md5 order.

Every operator ranks rows with ``seeded_row_number``, so a label that holds most of the table is
still ranked slice by slice. Outputs are one table with a role column, never two collected parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.operators.ordering import global_row_number, seeded_key, seeded_row_number, top_per_group
from sievecrest.session import cut_lineage


def _ratio(value: float, what: str) -> None:
    if not 0.0 < value < 1.0:
        raise ValueError(f"{what} must be in (0, 1)")


def stratified_split(
    df: DataFrame, id_col: str, label: str, ratio: float, seed: int, role: str = "role", names: Sequence[str] = ("val", "train")
) -> DataFrame:
    """First ``ratio`` of each label (at least one row, never all of them) gets ``names[0]``."""
    _ratio(ratio, "split ratio")
    ranked = seeded_row_number(df, id_col, seed, [label], "_rn", "_size")
    take = F.when(
        F.col("_size") > 1,
        F.least(F.greatest(F.lit(1), F.bround(F.col("_size") * ratio)), F.col("_size") - 1),
    ).otherwise(0)
    return ranked.withColumn(role, F.when(F.col("_rn") <= take, names[0]).otherwise(names[1])).drop("_rn", "_size")


def stratified_subsplit(df: DataFrame, id_col: str, label: str, ratio: float, seed: int, role: str = "role") -> DataFrame:
    """Split a validation table into threshold-search and model-selection parts."""
    return stratified_split(df, id_col, label, ratio, seed, role, ("threshold_search", "model_select"))


def stratified_group_split(
    df: DataFrame, label: str, group: str, ratio: float, seed: int, role: str = "role", strict: bool = False
) -> DataFrame:
    """Whole groups go to validation per label until their running size reaches the target.

    Works on the group-size table; rows only meet it in the final equi-join. A NULL group or label is
    a group or label of its own.
    """
    _ratio(ratio, "group split ratio")
    sizes = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("_n"))
    per_label = sizes.groupBy(label).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_groups"))
    if strict:
        ok = F.assert_true(F.col("_groups") >= 2, F.lit("group split needs two groups per label"))
        per_label = per_label.where(ok.isNull())
    per_label = per_label.withColumnRenamed(label, "_l")
    ordered = sizes.join(per_label, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    ordered = ordered.withColumn("_key", seeded_key(F.coalesce(F.col(group).cast("string"), F.lit("")), seed))
    # Sum of earlier groups in key order, sliced like the row ranks: the group table may be long too.
    ordered = ordered.withColumn("_slice", F.substring("_key", 1, 4))
    slice_sum = ordered.groupBy(label, "_slice").agg(F.sum("_n").alias("_sn"))
    before_slice = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = slice_sum.select(
        F.col(label).alias("_l"), F.col("_slice").alias("_os"), F.coalesce(F.sum("_sn").over(before_slice), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(label, "_slice").orderBy("_key", group).rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        ordered.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(shifts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_slice") == F.col("_os")))
        .withColumn("_target", F.greatest(F.lit(1), F.bround(F.col("_total") * ratio)))
        .withColumn(role, F.when(F.col("_shift") + F.col("_in") < F.col("_target"), "val").otherwise("train"))
        .select(label, group, role)
    )
    named = chosen.select(F.col(label).alias("_l"), F.col(group).alias("_g"), role)
    same = df[label].eqNullSafe(F.col("_l")) & df[group].eqNullSafe(F.col("_g"))
    return df.join(named, same).drop("_l", "_g")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int, seed: int, fold: str = "fold") -> DataFrame:
    """Validation fold 1..k of every row; fold sizes differ by at most one per label."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = seeded_row_number(df, id_col, seed, [label], "_rn")
    return ranked.withColumn(fold, ((F.col("_rn") - 1) % k + 1).cast("int")).drop("_rn")


def fold_roles(folds: DataFrame, k: int, fold: str = "fold", selected: Sequence[int] | None = None) -> DataFrame:
    """Every row once per fold with its role there; ``fold`` becomes the fold being described."""
    ids = list(selected or range(1, k + 1))
    return (
        folds.withColumnRenamed(fold, "_own")
        .withColumn(fold, F.explode(F.array(*[F.lit(int(i)) for i in ids])))
        .withColumn("role", F.when(F.col("_own") == F.col(fold), "val").otherwise("train"))
        .drop("_own")
    )


def parse_folds(raw: str, k: int) -> list[int]:
    """``"1,3"`` -> [1, 3]; empty means all folds."""
    picked = sorted({int(p) for p in raw.split(",") if p.strip()})
    if not raw.strip():
        return list(range(1, k + 1))
    if not picked or picked[0] < 1 or picked[-1] > k:
        raise ValueError(f"folds must be within 1..{k}")
    return picked


def fold_label_distribution(folds: DataFrame, label: str, k: int, fold: str = "fold") -> DataFrame:
    """Row counts per fold and role, by label and in total (label NULL on total rows).

    Counted from the k x label cell table: the rows are never copied k times.
    """
    cells = folds.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"))
    spread = fold_roles(cells, k, fold)
    totals = spread.groupingSets([[F.col(fold), F.col("role"), F.col(label)], [F.col(fold), F.col("role")]], fold, "role", label)
    return totals.agg(F.sum("n").alias("n"), (F.grouping(label) == 1).alias("is_total"))


def rebalance_to_ratio(df: DataFrame, id_col: str, label: str, ratio: float, seed: int) -> DataFrame:
    """Down-sample the over-represented class so that negatives:positives meets ``ratio``."""
    if ratio <= 0:
        raise ValueError("target ratio must be positive")
    counts = df.agg(
        F.struct(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    ).scalar()
    ranked = seeded_row_number(df.where(F.col(label).isin(0, 1)), id_col, seed, [label], "_rn").withColumn("_c", counts)
    too_many_pos = F.col("_c.neg") / F.col("_c.pos") < ratio
    keep_pos = F.when(too_many_pos, F.greatest(F.lit(1), F.bround(F.col("_c.neg") / ratio))).otherwise(F.col("_c.pos"))
    keep_neg = F.when(too_many_pos, F.col("_c.neg")).otherwise(F.greatest(F.lit(1), F.bround(F.col("_c.pos") * ratio)))
    limit = F.when(F.col(label) == 1, keep_pos).otherwise(keep_neg)
    return ranked.where(F.col("_rn") <= limit).drop("_rn", "_c")


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int) -> DataFrame:
    """Exactly ``bround(n * fraction)`` rows in md5 order."""
    ranked = seeded_row_number(df, id_col, seed, (), "_rn", "_size")
    return ranked.where(F.col("_rn") <= F.bround(F.col("_size") * fraction)).drop("_rn", "_size")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return seeded_row_number(df, id_col, seed, (), "_rn").where(F.col("_rn") <= n).drop("_rn")


def stratified_take(df: DataFrame, id_col: str, label: str, score: str, n: int) -> DataFrame:
    """Best ``max(1, n // labels)`` rows a label, then the best leftovers up to ``n``.

    Only the best ``n`` rows of a label can ever be taken, so each label is first cut to ``n``
    before any shuffle of the group; everything after works on labels x n written rows.
    """
    order = [F.col(score).desc(), F.col(id_col).asc()]
    known = df.where(F.col(label).isNotNull())
    labels = df.agg(F.greatest(F.lit(1), F.count_distinct(label))).scalar()
    top = cut_lineage(top_per_group(known, [label], order, n, id_col, "_rn"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / labels))
    top = top.withColumn("_quota", quota).withColumn("_lead", (F.col("_rn") <= F.col("_quota")).cast("int"))
    lead = top.agg(F.sum("_lead")).scalar()
    # The rest is filled from one list of at most labels x n rows; each task hands on its first n only.
    first = Window.partitionBy(F.lit(0)).orderBy(*order)
    rest = top.where(F.col("_lead") == 0).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    rest = rest.withColumn("_taken", lead).where(F.col("_r") <= n - F.col("_taken"))
    keep = [c for c in df.columns]
    return top.where(F.col("_lead") == 1).select(*keep).unionByName(rest.select(*keep))


def cluster_stratified_take(
    df: DataFrame, id_col: str, label: str, score: str, cluster: str, fraction: str, n: int
) -> DataFrame:
    """Take a quota from each cluster, clusters with the highest test fraction first, then fill to ``n``.

    Per cluster the quota is ``max(4, n // min(clusters, 12))`` taken label by label; clusters stop
    being visited once enough rows were taken; the result keeps the first ``n`` in visiting order.
    """
    order = [F.col(score).desc(), F.col(id_col).asc()]
    known = df.where(F.col(label).isNotNull())
    spread = known.groupBy(cluster).agg(F.max(fraction).alias("_frac"), F.count_distinct(label).alias("_labels"))
    n_clusters = spread.agg(F.count(F.lit(1))).scalar()
    quota = F.greatest(F.lit(4), F.floor(F.lit(n) / F.greatest(F.lit(1), F.least(n_clusters, F.lit(12)))))
    cap = max(4, n)
    top = top_per_group(known, [cluster, label], order, cap, id_col, "_rn")
    top = top.join(spread, cluster).withColumn("_q", quota)
    per_label = F.greatest(F.lit(1), F.floor(F.col("_q") / F.greatest(F.lit(1), F.col("_labels"))))
    top = top.withColumn("_lead", (F.col("_rn") <= per_label).cast("int"))
    # rank leads first, then leftovers by score, within each cluster (labels x cap rows a cluster)
    fill = Window.partitionBy(cluster).orderBy(F.col("_lead").desc(), *order)
    leads = F.sum("_lead").over(Window.partitionBy(cluster))
    taken = top.withColumn("_pos", F.row_number().over(fill)).withColumn("_leads", leads)
    taken = cut_lineage(taken.where(F.col("_pos") <= F.greatest(F.col("_leads"), F.col("_q"))))
    # visiting order of clusters: a table of one row per cluster
    visit = taken.groupBy(cluster).agg(F.max("_frac").alias("_frac"), F.count(F.lit(1)).alias("_got"))
    seq = Window.orderBy(F.col("_frac").desc(), F.col(cluster).asc())
    visit = visit.withColumn("_turn", F.row_number().over(seq)).withColumn(
        "_before", F.coalesce(F.sum("_got").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    visited = taken.join(visit.where(F.col("_before") < n).select(cluster, "_turn", "_before"), cluster)
    picked = visited.withColumn("_at", F.col("_before") + F.col("_pos")).where(F.col("_at") <= n)
    keep = list(df.columns)
    picked_rows = picked.select(*keep)
    got = picked.agg(F.count(F.lit(1))).scalar()
    left = known.join(picked.select(id_col), id_col, "left_anti")
    rest = global_row_number(left.select(id_col, score), order, "_r").withColumn("_got", got)
    fill_ids = rest.where(F.col("_r") <= n - F.col("_got")).select(id_col)
    return picked_rows.unionByName(known.join(fill_ids, id_col, "left_semi").select(*keep))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order: a min over structs, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in set(key) | set(order)]
    packed = F.min_by(F.struct(*[F.col(c) for c in [*order, *rest]]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(packed.alias("_f")).select(*key, "_f.*").select(*df.columns)


