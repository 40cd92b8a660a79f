"""Table-combining operators: merges, baselines, asset lookup, masks and provenance unions.

Strategies are left to Catalyst and AQE: small id lists broadcast by size, large ones sort-merge with
skew splitting. No join here forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.functions import keys as K


def merge_features(base: DataFrame, tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Left-merge a chain of feature tables that share a unique key."""
    out = base
    for t in tables:
        out = out.join(t, key, "left")
    return out


def prefixed(df: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    return df.select(F.col(key), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])


def label_votes(ids: DataFrame, labels: DataFrame, key: str = "id", model: str = "model", label: str = "label") -> DataFrame:
    """Votes of any number of label tables in long form (key, model, label); ids without votes stay.

    A label of -1 or NULL means the model did not score the row.
    """
    scored = F.when(F.col(label) >= 0, F.col(label))
    votes = labels.groupBy(key).agg(
        F.coalesce(F.sum(scored), F.lit(0)).cast("bigint").alias("pos_votes"), F.count(scored).alias("model_count")
    )
    return (
        ids.join(votes, key, "left")
        .withColumn("pos_votes", F.coalesce("pos_votes", F.lit(0)))
        .withColumn("model_count", F.coalesce("model_count", F.lit(0)))
        .withColumn("pos_frac", F.try_divide("pos_votes", "model_count"))
        .withColumn("neg_votes", F.col("model_count") - F.col("pos_votes"))
    )


def require_same_ids(baseline: DataFrame, candidate: DataFrame, by: Sequence[str] = (), key: str = "id") -> None:
    """Error if a candidate set lacks ids of the baseline or has others; both sides of an inner join would hide it."""
    ids = baseline.select(F.col(key).alias("_id")).distinct()
    groups = candidate.select(*by).distinct() if by else candidate.sparkSession.range(1).select()
    want = groups.join(ids)
    mine = candidate.select(*by, F.col(key).alias("_id")).distinct()
    on = [*by, "_id"]
    lacking, other = want.join(mine, on, "left_anti").count(), mine.join(ids, "_id", "left_anti").count()
    if lacking or other:
        raise ValueError(f"candidate and baseline ids differ: {lacking} missing, {other} unknown")


def baseline_diff(baseline: DataFrame, candidate: DataFrame, by: Sequence[str] = (), key: str = "id", n: int = 25, same_ids: bool = False) -> DataFrame:
    """Positives, differences and flips of candidate labels against a baseline, with example ids.

    ``same_ids`` makes differing id sets an error instead of comparing the common ids.
    The example lists come from a top-n per flip direction, so no group's ids are gathered whole.
    """
    by = list(by)
    if same_ids:
        require_same_ids(baseline, candidate, by, key)
    joined = candidate.select(key, *by, F.col("label").alias("_c")).join(
        baseline.select(key, F.col("label").alias("_b")), key
    )
    down = (F.col("_b") == 1) & (F.col("_c") != 1)
    up = (F.col("_b") != 1) & (F.col("_c") == 1)
    counts = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_c") == 1).alias("positives"),
        F.count_if(F.col("_c") != F.col("_b")).alias("diff_vs_baseline"),
        F.count_if(down).alias("baseline_pos_to_neg"),
        F.count_if(up).alias("baseline_neg_to_pos"),
    )
    flips = joined.withColumn("_dir", F.when(down, "down").when(up, "up")).where(F.col("_dir").isNotNull())
    first = F.row_number().over(Window.partitionBy(*by, "_dir").orderBy(key))
    few = flips.withColumn("_rn", first).where(F.col("_rn") <= n)

    def listing(direction: str) -> Column:
        ids = F.array_sort(F.collect_list(F.when(F.col("_dir") == direction, F.col(key))))
        return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")

    lists = few.groupBy(*by).agg(listing("down").alias("pos_to_neg_ids"), listing("up").alias("neg_to_pos_ids"))
    if by:
        out = counts.join(lists, by, "left")
    else:
        packed = lists.select(F.struct("pos_to_neg_ids", "neg_to_pos_ids").alias("p")).scalar()
        out = counts.withColumn("_p", packed).select(*counts.columns, "_p.*")
    return out.withColumn("pos_to_neg_ids", F.coalesce("pos_to_neg_ids", F.lit(""))).withColumn(
        "neg_to_pos_ids", F.coalesce("neg_to_pos_ids", F.lit(""))
    )


def baseline_fill(baseline: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Every baseline id; the prediction where there is one, else the baseline label."""
    pred = predictions.select(key, F.col("label").alias("_p"), "prob_pos")
    return baseline.join(pred, key, "left").select(
        key,
        F.coalesce("_p", "label").alias("label"),
        "prob_pos",
        F.col("_p").isNull().alias("filled_from_baseline"),
    )


def resolve_assets(df: DataFrame, assets: DataFrame, candidates: Sequence[tuple[int, Column]], key: str, name: str = "name") -> DataFrame:
    """First existing candidate name per row, by priority.

    ``candidates`` are (priority, name expression) pairs; ``assets`` has (name, path, status). One
    equi-join on the name, then a map-side combined ``min_by``.
    """
    wanted = df.select(
        key, F.inline(F.array(*[F.struct(F.lit(p).alias("_prio"), c.alias("_name")) for p, c in candidates]))
    )
    hits = wanted.join(assets.select(F.col(name).alias("_name"), "path", "status"), "_name")
    best = hits.groupBy(key).agg(F.min_by(F.struct("path", "status"), F.struct("_prio", "_name", "path")).alias("_b"))
    return df.join(best, key, "left").select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.col("_b.path"), F.lit("")).alias("path"),
        F.coalesce(F.col("_b.status"), F.lit("missing")).alias("mask_status"),
    )


def alias_index(assets: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(name, path) lookup where a stem used once also answers to the other image suffixes."""
    base = assets.select(F.col(name).alias("name"), F.col(path).alias("path"))
    stems = base.withColumn("_stem", K.stem(F.col("name")))
    unique = stems.groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where(F.col("_n") == 1)
    aliases = unique.select(
        F.explode(F.transform(F.array(*[F.lit(s) for s in K.IMAGE_SUFFIXES]), lambda s: F.concat(F.col("_stem"), s))).alias("name"),
        "path",
    )
    exact = base.groupBy("name").agg(F.max("path").alias("path"))
    return exact.unionByName(aliases.join(exact.select("name"), "name", "left_anti"))


def mask_index(ids: DataFrame, masks: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """First mask of every image (``<stem>_mask_000.png``) and whether there is one."""
    wanted = ids.withColumn("_name", F.concat(K.stem(F.col(key)), F.lit("_mask_000.png")))
    found = masks.groupBy(F.col(name).alias("_name")).agg(F.min("path").alias("mask_path"))
    return wanted.join(found, "_name", "left").drop("_name").withColumn("masked", F.col("mask_path").isNotNull())


def mask_fanout(ids: DataFrame, masks: DataFrame, markers: DataFrame, key: str = "stem") -> DataFrame:
    """Mask count, no-mask flag and missing-marker flag of every image."""
    per = masks.groupBy(key).agg(F.count(F.lit(1)).alias("mask_count"))
    seen = markers.select(key).distinct().withColumn("_marker", F.lit(True))
    return (
        ids.join(per, key, "left")
        .join(seen, key, "left")
        .withColumn("mask_count", F.coalesce("mask_count", F.lit(0)))
        .withColumn("nomask", F.col("mask_count") == 0)
        .withColumn("missing_marker", F.col("nomask") & F.col("_marker").isNull())
        .drop("_marker")
    )


def instances_or_originals(ids: DataFrame, masks: DataFrame, key: str = "stem") -> DataFrame:
    """Masked instances, and the original image for ids that have none."""
    masked = ids.join(masks, key).withColumn("kind", F.lit("mask"))
    rest = ids.join(masks.select(key), key, "left_anti").withColumn("kind", F.lit("original"))
    return masked.unionByName(rest, allowMissingColumns=True)


def force_zero(df: DataFrame, numbers: DataFrame, id_col: str = "id", number: str = "number") -> DataFrame:
    """Label 0 for rows whose id number is listed; ``zeroed`` marks the rows on the list."""
    listed = numbers.select(F.col(number).cast("string").alias("_num")).distinct().withColumn("_hit", F.lit(True))
    tagged = df.withColumn("_num", K.extract_number(F.col(id_col).cast("string")))
    return (
        tagged.join(listed, "_num", "left")
        .withColumn("label", F.when(F.col("_hit"), 0).otherwise(F.col("label")))
        .withColumn("zeroed", F.coalesce("_hit", F.lit(False)))
        .drop("_num", "_hit")
    )


def interpolate_vectors(a: DataFrame, b: DataFrame, alpha: float, key: str = "key", values: str = "values") -> DataFrame:
    """``(1 - alpha) * a + alpha * b`` on shared keys; keys only in ``a`` stay, only in ``b`` drop."""
    other = b.select(key, F.col(values).alias("_b"))
    mixed = F.zip_with(F.col(values), F.col("_b"), lambda x, y: x * (1.0 - alpha) + y * alpha)
    return a.join(other, key, "left").select(key, F.coalesce(mixed, F.col(values)).alias(values))


def concat_features(tables: Sequence[DataFrame], key: str = "sample_id", values: str = "embedding") -> DataFrame:
    """Concatenate feature vectors of several backbones by key."""
    out = tables[0].select(key, F.col(values).alias("_v0"))
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select(key, F.col(values).alias(f"_v{i}")), key)
    return out.select(key, F.concat(*[f"_v{i}" for i in range(len(tables))]).alias(values))


def merge_with_weights(parts: Mapping[str, tuple[DataFrame, float]]) -> DataFrame:
    """Union of labelled tables with a source tag and a sample weight."""
    out = None
    for source, (df, weight) in parts.items():
        tagged = df.withColumn("source", F.lit(source)).withColumn("sample_weight", F.lit(float(weight)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def id_set_diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Sizes of the set difference both ways and of the intersection."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    both = left.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
    )
