"""Run histories: running best, early stop, best epoch and experiment-ledger analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.functions.scores import bayes_prior_correct
from sievecrest.operators.metrics import best_threshold, f1_from_counts
from sievecrest.operators.ordering import running_max
from sievecrest.session import cut_lineage


def running_best(df: DataFrame, epoch: str = "epoch", score: str = "val_f1", patience: int | None = None, run: str | None = None) -> DataFrame:
    """Best score so far, strict improvements, epochs since the last one, and the stop flag.

    Windows run within a run; a history is one row per epoch.
    """
    part = [run] if run else []
    past = Window.partitionBy(*part).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*part).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("improved", F.coalesce(F.col(score) > F.max(score).over(past), F.lit(True)))
    seen = F.row_number().over(Window.partitionBy(*part).orderBy(epoch))
    out = out.withColumn("_n", seen).withColumn("_last", F.max(F.when(F.col("improved"), F.col("_n"))).over(upto))
    out = out.withColumn("best_so_far", F.max(score).over(upto)).withColumn("since_best", (F.col("_n") - F.col("_last")).cast("int"))
    if patience is not None:
        out = out.withColumn("stop", F.col("since_best") >= patience)
    return out.drop("_n", "_last")


def early_stop_epoch(history: DataFrame, epoch: str = "epoch", run: str | None = None) -> DataFrame:
    """First epoch whose stop flag is set."""
    return history.where("stop").groupBy(*([run] if run else [])).agg(F.min(epoch).alias("stop_epoch"))


def best_epoch(df: DataFrame, epoch: str = "epoch", score: str = "val_f1", run: str | None = None) -> DataFrame:
    """First epoch with the highest score."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e")))
    return df.groupBy(*([run] if run else [])).agg(best.alias("_b")).select(
        *([run] if run else []), (-F.col("_b.e")).alias("best_epoch"), F.col("_b.s").alias("best_score")
    )


def epoch_selection(
    df: DataFrame, train_pi: Column | float, target_pi: Column | float, search_threshold: bool = True, correct: bool = True, patience: int | None = 6,
    run: str | None = None,
) -> DataFrame:
    """Per epoch: threshold from the search subset, F1 on the selection subset, running best and stop.

    ``df`` has epoch, id, prob, label and subset ('search' or 'select'); ``run`` names a column that
    keeps several histories apart.
    """
    keys = [*([run] if run else []), "epoch"]
    prob = bayes_prior_correct(F.col("prob"), train_pi, target_pi) if correct else F.col("prob")
    scored = df.withColumn("_p", prob)
    if search_threshold:
        found = best_threshold(scored.where("subset = 'search'"), "_p", "label", keys)
    else:
        found = scored.select(*keys).distinct().withColumn("threshold", F.lit(0.5)).withColumn("best_f1", F.lit(None).cast("double"))
    held = scored.where("subset = 'select'").join(found, keys)
    called = F.col("_p") >= F.col("threshold")
    counts = held.groupBy(*keys, "threshold", F.col("best_f1").alias("search_f1")).agg(
        F.count_if(called & (F.col("label") == 1)).alias("tp"),
        F.count_if(called & (F.col("label") == 0)).alias("fp"),
        F.count_if(~called & (F.col("label") == 1)).alias("fn"),
    )
    table = counts.withColumn("val_f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))).drop("tp", "fp", "fn")
    return running_best(table, "epoch", "val_f1", patience, run=run)


def parse_settings(text: Column) -> Column:
    """``a=1; b=2`` -> map of trimmed keys and values."""
    return F.str_to_map(F.regexp_replace(F.trim(text), r"\s*;\s*", ";"), F.lit(";"), F.lit("="))


def ledger_progress(df: DataFrame, order: str, metric: str, group: str) -> DataFrame:
    """Running best of a metric in entry order within each group of runs."""
    seen = running_max(cut_lineage(df), order, metric, [group], "_before")
    return seen.select(
        *df.columns,
        F.greatest(metric, "_before").alias("best_so_far"),
        F.coalesce(F.col(metric) > F.col("_before"), F.lit(True)).alias("improved"),
    )


def keep_rates(df: DataFrame, by: str, status: str = "status", metric: str = "primary_metric") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col(status) == "keep").alias("kept"),
        (F.count_if(F.col(status) == "keep") / F.count(F.lit(1))).alias("keep_rate"),
        F.max(metric).alias("best_metric"),
    )
