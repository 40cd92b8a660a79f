"""Row filters that also report what they dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.functions.scores import confidence
from sievecrest.operators.checks import examples, require_range


def skip_ids(df: DataFrame, skips: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(skips.select(F.col(id_col)).distinct(), id_col, "left_anti")


def skip_report(df: DataFrame, skips: DataFrame, id_col: str = "id", n: int = 10) -> DataFrame:
    """Requested, matched, unmatched and remaining counts with unmatched examples."""
    asked = skips.select(F.col(id_col)).distinct()
    found = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    flagged = asked.join(found, id_col, "left")
    unmatched = flagged.where(F.col("_rows").isNull())
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        flagged.agg(
            F.count(F.lit(1)).alias("requested"),
            F.count("_rows").alias("matched"),
            F.count_if(F.col("_rows").isNull()).alias("unmatched"),
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("_gone"),
        )
        .withColumn("remaining", total - F.col("_gone"))
        .drop("_gone")
        .withColumn("unmatched_examples", examples(unmatched, id_col, n).scalar())
    )


def duplicate_name_report(df: DataFrame, name: str, skips: DataFrame, n: int = 10) -> DataFrame:
    """Kept and skipped rows and names that occur more than once among the kept rows."""
    per_name = df.groupBy(name).agg(F.count(F.lit(1)).alias("_rows"))
    marked = per_name.join(skips.select(name).distinct().withColumn("_skip", F.lit(True)), name, "left")
    dup = marked.where(F.col("_skip").isNull() & (F.col("_rows") > 1))
    return marked.agg(
        F.coalesce(F.sum(F.when(F.col("_skip").isNull(), F.col("_rows"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("_skip").isNotNull(), F.col("_rows"))), F.lit(0)).alias("skipped"),
        F.count_if(F.col("_skip").isNull() & (F.col("_rows") > 1)).alias("duplicate_names"),
    ).withColumn("duplicate_examples", examples(dup, name, n).scalar())


def mask_quality(ratio: Column, has_mask: Column, area_threshold: float = 0.005) -> Column:
    """``no_mask``, ``small`` or ``keep``."""
    return F.when(~F.coalesce(has_mask, F.lit(False)), "no_mask").when(ratio < area_threshold, "small").otherwise("keep")


def labelled_source(df: DataFrame, source: str) -> DataFrame:
    """Rows of one source that have an image and a label."""
    keep = (F.col("source") == source) & F.col("label").isNotNull()
    if "has_image" in df.columns:
        keep = keep & F.col("has_image")
    return df.where(keep)


def pseudo_labels(df: DataFrame, threshold: float, prob: str = "prob_pos_corrected") -> DataFrame:
    """Confident predictions as labelled rows; an empty result keeps the schema."""
    require_range("confidence threshold", threshold, 0.5, 1.0)
    conf = confidence(F.col(prob))
    label = (F.col(prob) >= 0.5).cast("int")
    return df.where(conf >= threshold).select(
        "id", label.alias("label"), label.alias("label_idx"), F.col(prob), conf.alias("pseudo_confidence"), F.lit("pseudo").alias("source")
    )


def keep_lines(lines: Column, min_score: float) -> Column:
    """Recognised lines at or above a score (a missing score passes), trimmed, without empties."""
    trimmed = F.transform(lines, lambda s: F.struct(F.trim(s["text"]).alias("text"), s["score"].alias("score")))
    return F.filter(trimmed, lambda s: (s["score"].isNull() | (s["score"] >= min_score)) & (s["text"] != ""))


def matched_rules(df: DataFrame, rules: Mapping[str, Column], name: str = "rule") -> DataFrame:
    """One row per (row, rule it satisfies); ``rules`` maps names to conditions, and a NULL condition is not met."""
    hits = F.array_compact(F.array(*[F.when(mask, F.lit(rule)) for rule, mask in rules.items()]))
    return df.withColumn(name, F.explode(hits))


def in_any(col: str, values: Sequence) -> Column:
    return F.col(col).isin(*values) if values else F.lit(False)
