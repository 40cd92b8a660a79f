"""Averaging over instances, views, models and model combinations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.operators.metrics import best_from_cells, f1_from_counts, score_cells
from sievecrest.session import cut_lineage


def pool_instances(ids: DataFrame, instances: DataFrame, key: str = "id", prob: str = "prob") -> DataFrame:
    """Mean instance probability of every id; 0.0 where there are no instances."""
    pooled = instances.groupBy(key).agg(F.avg(prob).alias("prob_pos"), F.count(prob).alias("instances"))
    return (
        ids.join(pooled, key, "left")
        .withColumn("prob_pos", F.coalesce("prob_pos", F.lit(0.0)))
        .withColumn("instances", F.coalesce("instances", F.lit(0)))
    )


def mean_over(df: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """Mean over views or models of a long table."""
    return df.groupBy(*keys).agg(F.avg(prob).alias("prob_pos"), F.count(prob).alias("n_views"))


def pool_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean of equal-length vectors per key.

    The summarizer keeps one running mean a key and task, so hot keys combine map-side and no
    (row, position) pair is ever shuffled.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(key).agg(vector_to_array(mean).alias(vector))


def bag_probabilities(df: DataFrame, models: int, key: str = "id", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Mean over model tables (long form); ``complete`` is false where an id misses a model or repeats one.

    The mean meets the threshold to nine digits, so the order in which it was summed decides no label.
    """
    return (
        df.groupBy(key)
        .agg(
            F.avg(prob).alias("prob_pos_corrected"),
            F.count(prob).alias("_rows"),
            F.count_distinct("model").alias("_models"),
        )
        .select(
            key,
            "prob_pos_corrected",
            (F.round("prob_pos_corrected", 9) >= threshold).cast("int").alias("label"),
            ((F.col("_models") == models) & (F.col("_rows") == models)).alias("complete"),
        )
    )


def vote_audit(df: DataFrame, key: str = "id", prob: str = "prob", label: str = "label") -> DataFrame:
    """Mean and maximum probability and label votes over models in long form."""
    return df.groupBy(key).agg(
        F.avg(prob).alias("prob_mean"),
        F.max(prob).alias("prob_max"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("label_votes_pos"),
        F.count(label).alias("label_votes_total"),
    )


def model_combinations(models: Sequence[str], low: int = 2, high: int = 5) -> list[tuple[str, ...]]:
    """Combinations of model names; names are configuration, not data."""
    ordered = sorted(models)
    return [c for r in range(low, min(high, len(ordered)) + 1) for c in combinations(ordered, r)]


def combination_table(models: DataFrame, name: str = "model", low: int = 2, high: int = 5) -> DataFrame:
    """All ``low..high`` sized combinations of a (tiny) model table as (ensemble, n_models, members).

    Grown one member at a time by an ordered self-join of the model names.
    """
    base = models.select(F.col(name).alias("m")).distinct()
    level = base.select(F.array("m").alias("members"), F.col("m").alias("last"))
    out = None
    for size in range(2, high + 1):
        level = level.join(base, F.col("m") > F.col("last")).select(
            F.concat("members", F.array("m")).alias("members"), F.col("m").alias("last")
        )
        if size >= low:
            out = level if out is None else out.unionByName(level)
    return out.select(
        F.array_join("members", " + ").alias("ensemble"), F.size("members").alias("n_models"), "members"
    )


def combination_cells(
    rows: DataFrame, dataset: str, label: str, probs: str, combos: Sequence[tuple[int, ...]]
) -> DataFrame:
    """(dataset, combo, score, n, pos, neg): score cells of the mean over every combination of model columns.

    ``probs`` is an array with one probability a model; ``combos`` are ascending positions in it. Sums
    of a block of rows are shared along a prefix tree of the combinations, one vector addition each, in
    member order; the block leaves as cells of its distinct scores, so no row is repeated per
    combination. A row without one of the members' probabilities has no score there.
    """
    order = sorted(range(len(combos)), key=lambda i: combos[i])

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups = batch.column(0).dictionary_encode()
        group = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
        names = pa.concat_arrays([groups.dictionary, pa.nulls(1, groups.dictionary.type)])
        flat = batch.column(2).flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        values = flat.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        truth = batch.column(1).to_numpy(zero_copy_only=False)
        pos, neg = (truth == 1).astype(np.int64), (truth == 0).astype(np.int64)
        path: list[tuple[int, np.ndarray, np.ndarray]] = []  # members chosen so far with sum and rows that have all
        made: list[list[np.ndarray]] = []
        size = 0
        for i in order:
            same = 0
            while same < min(len(path), len(combos[i])) and path[same][0] == combos[i][same]:
                same += 1
            del path[same:]
            for m in combos[i][same:]:
                before = path[-1][1:] if path else (0.0, np.ones(len(batch), bool))
                path.append((m, before[0] + values[:, m], before[1] & known[:, m]))
            at = np.flatnonzero(path[-1][2])
            score = path[-1][1][at] / len(combos[i])
            at = at[by := np.lexsort((score, group[at]))]
            score = score[by]
            if not len(at):
                continue
            first = np.flatnonzero(np.append(True, (group[at][1:] != group[at][:-1]) | (score[1:] != score[:-1])))
            counts = [np.diff(np.append(first, len(at))), np.add.reduceat(pos[at], first), np.add.reduceat(neg[at], first)]
            made.append([group[at][first], np.full(len(first), i, np.int32), score[first], *counts])
            size += len(first)
            if size >= 1 << 20:
                yield packed(names, made)
                made, size = [], 0
        if made:
            yield packed(names, made)

    def packed(names: pa.Array, made: list[list[np.ndarray]]) -> pa.RecordBatch:
        group, *rest = (np.concatenate(c) for c in zip(*made))
        return pa.RecordBatch.from_arrays([names.take(pa.array(group)), *map(pa.array, rest)], [dataset, "combo", "score", "n", "pos", "neg"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from block(batch)

    group_type = rows.schema[dataset].dataType.simpleString()
    cells = rows.select(dataset, F.col(label).cast("double").alias("label"), probs).mapInArrow(
        work, f"`{dataset}` {group_type}, combo int, score double, n long, pos long, neg long"
    )
    return cells.groupBy(dataset, "combo", "score").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")])


def ensemble_search(
    probs: DataFrame, dataset: str, key: str, label: str, low: int = 2, high: int = 5, model: str = "model", prob: str = "prob"
) -> DataFrame:
    """F1 at 0.5, best F1 and threshold of the mean probability of every model combination.

    Each row first gathers its few model probabilities into an array (one shuffle by id); blocks of
    rows become score cells of all combinations (``combination_cells``), from which every figure comes.
    Model names are configuration: few, and listed by the driver.
    """
    models = sorted(r[0] for r in probs.select(model).where(F.col(model).isNotNull()).distinct().collect())
    combos = model_combinations(models, low, high)
    place = {m: i for i, m in enumerate(models)}
    rows = probs.groupBy(dataset, key).agg(
        F.max(label).alias(label), F.map_from_entries(F.collect_list(F.struct(model, prob))).alias("_p")
    )
    rows = rows.select(dataset, label, F.array(*[F.col("_p")[m].cast("double") for m in models]).cast("array<double>").alias("_v"))
    cells = cut_lineage(combination_cells(rows, dataset, label, "_v", [tuple(place[m] for m in c) for c in combos]))
    by = [dataset, "combo"]
    at = F.col("score") >= 0.5

    def at_half(called, c: str):
        return F.coalesce(F.sum(F.when(called, F.col(c))), F.lit(0))

    base = cells.groupBy(*by).agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("prob_mean"),
        f1_from_counts(at_half(at, "pos"), at_half(at, "neg"), at_half(~at, "pos")).alias("f1_at_0_5"),
    )
    found = base.join(best_from_cells(cells, by).withColumnRenamed("threshold", "best_threshold"), by)
    listed = [F.struct(F.lit(" + ".join(c)).alias("ensemble"), F.lit(len(c)).alias("n_models")) for c in combos]
    names = F.array(*listed).cast("array<struct<ensemble:string,n_models:int>>")
    named = found.withColumn("_c", F.get(names, F.col("combo")))
    return named.select(dataset, "_c.*", "prob_mean", "f1_at_0_5", "best_threshold", "best_f1")
