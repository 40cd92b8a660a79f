"""Ladders of candidate prediction tables derived from one scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.operators.metrics import calibrate_to_positive_count


def calibrated_ladder(baseline: DataFrame, predictions: DataFrame, targets: Sequence[int], prob: str = "prob_pos") -> DataFrame:
    """For each target positive count: calibrated threshold, baseline fill and flip counts.

    The targets' thresholds come back as one small array, so the rows are scanned once for all.
    """
    cuts = calibrate_to_positive_count(predictions, prob, targets)
    packed = cuts.agg(F.collect_list(F.struct("target", "threshold"))).scalar()
    filled = baseline.select("id", F.col("label").alias("_b")).join(predictions.select("id", prob), "id", "left")
    rows = filled.withColumn("_c", F.explode(packed)).withColumn(
        "_l", F.coalesce((F.col(prob) >= F.col("_c.threshold")).cast("int"), F.col("_b"))
    )
    return rows.groupBy(F.col("_c.target").alias("target")).agg(
        F.count_if(F.col("_l") == 1).alias("positives"),
        F.count_if(F.col(prob).isNull()).alias("filled"),
        F.count_if(F.col("_l") != F.col("_b")).alias("diff_vs_baseline"),
        F.count_if((F.col("_b") == 1) & (F.col("_l") == 0)).alias("baseline_pos_to_neg"),
        F.count_if((F.col("_b") == 0) & (F.col("_l") == 1)).alias("baseline_neg_to_pos"),
    )


def risk_ladder(listed: DataFrame, ranked: DataFrame, steps: Sequence[int], id_col: str = "id", rank: str = "rank") -> DataFrame:
    """Existing id list joined with the ``n`` riskiest ids, for every ``n`` of the ladder: (n, id)."""
    ladder = F.explode(F.array(*[F.lit(int(n)) for n in steps]))
    top = ranked.where(F.col(rank) <= max(steps)).withColumn("n", ladder).where(F.col(rank) <= F.col("n")).select("n", id_col)
    base = listed.select(id_col).distinct().withColumn("n", ladder).select("n", id_col)
    return base.unionByName(top).distinct()


def zeroed_candidates(current: DataFrame, selections: DataFrame, names: Sequence[str], id_col: str = "id", name: str = "rule") -> DataFrame:
    """Current predictions once per rule (or tier set) with the selected ids set to 0: (rule, id, label)."""
    fanned = current.withColumn(name, F.explode(F.array(*[F.lit(n) for n in names])))
    hits = selections.select(name, id_col).distinct().withColumn("_hit", F.lit(True))
    return fanned.join(hits, [name, id_col], "left").select(
        name, id_col, F.when(F.col("_hit"), 0).otherwise(F.col("label")).alias("label")
    )


def probes_against_baseline(scored: DataFrame, baseline: DataFrame, setting: str = "C", prob: str = "prob_pos", threshold: float = 0.5) -> DataFrame:
    """Per probe setting: rows scored and filled, positives, mean probability and flips.

    Rows a probe did not score keep the baseline label, so they never differ: everything but the
    fill count comes from the scored rows, and the baseline is not repeated per setting.
    """
    base = baseline.select("id", F.col("label").alias("_b"))
    whole = base.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_b") == 1).alias("pos"))).scalar()
    joined = scored.select("id", setting, prob).join(base, "id").withColumn("_l", (F.col(prob) >= threshold).cast("int"))
    per = joined.groupBy(setting).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("_l") == 1).alias("scored_positives"),
        F.avg(prob).alias("prob_mean"),
        F.count_if(F.col("_l") != F.col("_b")).alias("diff_vs_baseline"),
        F.count_if((F.col("_b") == 1) & (F.col("_l") == 0)).alias("baseline_pos_to_neg"),
        F.count_if((F.col("_b") == 0) & (F.col("_l") == 1)).alias("baseline_neg_to_pos"),
    )
    out = per.withColumn("_w", whole).withColumn("filled", F.col("_w.n") - F.col("scored"))
    positives = F.col("_w.pos") - F.col("baseline_pos_to_neg") + F.col("baseline_neg_to_pos")
    return out.withColumn("positives", positives).drop("_w")
