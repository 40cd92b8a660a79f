"""Priors, thresholds, F1 and evaluation tables, grouped and distributed over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.functions.scores import clamp
from sievecrest.operators.ordering import average_ranks, running_totals
from sievecrest.session import cut_lineage


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    precision = tp / F.greatest(F.lit(1), tp + fp)
    recall = tp / F.greatest(F.lit(1), tp + fn)
    return F.when(precision + recall == 0, 0.0).otherwise(2.0 * precision * recall / (precision + recall))


# ---- priors -------------------------------------------------------------------------------


def class_priors(df: DataFrame, label: str = "label", by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Class counts, priors and negative:positive ratio; ``strict`` raises on an empty class."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) != 1)
    out = df.groupBy(*by).agg(neg.alias("negatives"), pos.alias("positives")).withColumn(
        "total", F.col("negatives") + F.col("positives")
    )
    if strict:
        ok = F.assert_true(
            (F.col("negatives") > 0) & (F.col("positives") > 0), F.lit("class priors need one row of each class")
        )
        out = out.where(ok.isNull())
    return out.select(
        *by,
        "negatives",
        "positives",
        "total",
        F.try_divide("negatives", "total").alias("neg_prior"),
        F.try_divide("positives", "total").alias("pos_prior"),
        F.try_divide("negatives", "positives").alias("neg_pos_ratio"),
    )


def with_target_weights(priors: DataFrame, target_ratio: float) -> DataFrame:
    """Target priors for a negative:positive ratio and class weights with mean one."""
    if target_ratio <= 0:
        raise ValueError("target ratio must be positive")
    target_pos = 1.0 / (1.0 + float(target_ratio))
    neg = clamp(F.lit(1.0 - target_pos)) / clamp(F.col("neg_prior"))
    pos = clamp(F.lit(target_pos)) / clamp(F.col("pos_prior"))
    return (
        priors.withColumn("target_pos_prior", F.lit(target_pos))
        .withColumn("_n", neg)
        .withColumn("_p", pos)
        .withColumn("neg_weight", F.col("_n") / ((F.col("_n") + F.col("_p")) / 2.0))
        .withColumn("pos_weight", F.col("_p") / ((F.col("_n") + F.col("_p")) / 2.0))
        .drop("_n", "_p")
    )


# ---- F1 and thresholds --------------------------------------------------------------------


def f1_at(df: DataFrame, score: str, label: str, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    called = F.col(score) >= threshold
    tp = F.count_if(called & (F.col(label) == 1))
    fp = F.count_if(called & (F.col(label) == 0))
    fn = F.count_if(~called & (F.col(label) == 1))
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn(
        "f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    )


def score_cells(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, distinct score): row count, positives and negatives.

    Rows without a score (see ``unscored_rows``) are no candidates and count nowhere.
    """
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    )


def unscored_rows(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows that a sweep leaves out because they have no score."""
    return df.groupBy(*by).agg(F.count_if(F.col(score).isNull()).alias("unscored"))


DEFAULT_CUTS = (0.0, 0.5, 1.0)


def threshold_sweep(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 of calling everything at or above each distinct score, from descending running totals.

    One pass over distinct scores instead of a rescan a threshold. Callers hand in written cells: the
    bounds, the range totals and the sweep all read them. ``_at`` holds the rows at or above
    each default cut, which is all a cut between two scores needs.
    """
    by = list(by)
    swept = running_totals(cells, "score", ["n", "pos", "neg"], by=by)
    above = F.array(*[F.coalesce(F.sum(F.when(F.col("score") >= c, F.col("n"))), F.lit(0)) for c in DEFAULT_CUTS])
    whole = cells.groupBy(*by).agg(F.sum("pos").alias("_all_pos"), F.sum("n").alias("_all"), above.alias("_at"))
    if by:
        swept = swept.join(whole, by)
    else:
        packed = whole.select(F.struct("_all_pos", "_all", "_at")).scalar()
        swept = swept.withColumn("_w", packed).select(*swept.columns, "_w.*")
    f1 = f1_from_counts(F.col("cum_pos"), F.col("cum_neg"), F.col("_all_pos") - F.col("cum_pos"))
    return swept.withColumn("f1", f1).drop("_all_pos")


def best_from_cells(cells: DataFrame, by: Sequence[str] = (), start: float = float("-inf")) -> DataFrame:
    """``best_threshold`` on (by, score, n, pos, neg) cells."""
    best = threshold_sweep(cells, by).groupBy(*by).agg(_best_cut())
    f1, t = F.col("_b.f1"), _cut_threshold()
    if start >= 0:
        keep = f1 > start
        return best.select(
            *by, F.when(keep, t).otherwise(0.5).alias("threshold"), F.when(keep, f1).otherwise(start).alias("best_f1")
        )
    return best.select(*by, t.alias("threshold"), f1.alias("best_f1"))


def _best_cut() -> Column:
    """Highest F1 of a sweep; the lowest score among ties."""
    return F.max(F.struct(F.col("f1"), (-F.col("score")).alias("nt"), F.col("cum_n"), F.col("_at"))).alias("_b")


def _cut_threshold() -> Column:
    """Threshold of ``_best_cut``.

    A default cut at or below the score with no row in between calls the same rows, and the lower
    one wins.
    """
    score = -F.col("_b.nt") + 0.0
    cuts = [
        F.when((F.lit(c) <= score) & (F.get("_b._at", F.lit(i)) == F.col("_b.cum_n")), F.lit(c)) for i, c in enumerate(DEFAULT_CUTS)
    ]
    return F.least(score, *cuts)


def best_threshold(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), start: float = float("-inf")
) -> DataFrame:
    """Smallest threshold with the highest F1 among all scores and 0, 0.5 and 1.

    ``start`` is the F1 a candidate must beat before the default of 0.5 is replaced: with ``0`` a
    group where nothing scores keeps 0.5, with a negative start the smallest candidate wins.
    """
    return best_from_cells(cut_lineage(score_cells(df, score, label, by)), by, start)


def grid_positive_counts(
    df: DataFrame, score: str, by: Sequence[str] = (), low: float = 1e-4, high: float = 0.95, steps: int = 500
) -> DataFrame:
    """Rows at or above each of ``steps`` evenly spaced thresholds.

    Each row falls into one grid slot (arithmetic plus a one-slot correction for float edges); the
    slot histogram is at most ``steps + 1`` rows a group, so the suffix sum is cheap.
    """
    by = list(by)
    step = (high - low) / (steps - 1)
    s = F.col(score)

    def grid(i: Column) -> Column:
        return F.when(i >= steps - 1, F.lit(high)).otherwise(i * F.lit(step) + F.lit(low))

    guess = F.floor((s - low) / step)
    bounded = F.least(F.greatest(guess, F.lit(-1)), F.lit(steps - 1))
    up = F.when((bounded < steps - 1) & (grid(bounded + 1) <= s), bounded + 1).otherwise(bounded)
    slot = F.when((up >= 0) & (grid(up) > s), up - 1).otherwise(up)
    hist = df.where(s.isNotNull()).groupBy(*by, slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    grid_rows = (
        df.groupBy(*by)
        .agg(F.lit(1).alias("_one"))
        .select(*by, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("slot"), F.lit(0).cast("bigint").alias("c"))
    )
    full = hist.unionByName(grid_rows).groupBy(*by, "slot").agg(F.sum("c").alias("c"))
    above = Window.partitionBy(*by).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        full.withColumn("positives", F.sum("c").over(above))
        .where(F.col("slot") >= 0)
        .select(*by, F.col("slot").alias("step"), grid(F.col("slot")).alias("threshold"), "positives")
    )


def calibrate_to_positive_count(
    df: DataFrame,
    score: str,
    targets: Sequence[int],
    by: Sequence[str] = (),
    low: float = 1e-4,
    high: float = 0.95,
    steps: int = 500,
) -> DataFrame:
    """First grid threshold whose positive count is nearest to each target."""
    counts = grid_positive_counts(df, score, by, low, high, steps)
    wanted = counts.withColumn("target", F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in targets])))
    best = wanted.groupBy(*by, "target").agg(
        F.min(F.struct(F.abs(F.col("positives") - F.col("target")).alias("d"), "step", "threshold", "positives")).alias("b")
    )
    return best.select(*by, "target", F.col("b.threshold").alias("threshold"), F.col("b.positives").alias("positives"))


# ---- exact order statistics ---------------------------------------------------------------


def exact_percentiles(
    df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linearly interpolated percentiles, one column a point, from ascending running counts.

    No group's values are gathered in one place: the two order statistics a point needs are looked
    up in the running counts of distinct values.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return percentiles_from_cells(cut_lineage(cells), value, points, by, names)


def percentiles_from_cells(
    cells: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """``exact_percentiles`` of (by, value, n) cells; callers hand in written ones."""
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in points])
    cells = cells.select(*by, F.col(value).alias("_v"), F.col("n").alias("_n"))
    cum = running_totals(cells, "_v", ["_n"], by=by, descending=False)
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        cum = cum.join(sizes, by)
    else:
        cum = cum.withColumn("_size", sizes.scalar())
    first = F.col("cum__n") - F.col("_n")
    picks, out = [], []
    for p, name in zip(points, names):
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        holds_low = (first <= low) & (low < F.col("cum__n"))
        holds_high = (first <= high) & (high < F.col("cum__n"))
        picks += [
            F.max(F.when(holds_low, F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(holds_high, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(pos - low).alias(f"_f_{name}"),
        ]
        low_v, high_v, f = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        # Weighted ends with one rounding of the sum, as SQL engines interpolate: gates at a tie see the same value.
        mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low_v.cast("double"), 1.0 - f, high_v * f).cast("double")
        out.append(F.when(low_v.isNotNull() & high_v.isNotNull(), mixed).alias(name))
    return cum.groupBy(*by).agg(*picks).select(*by, *out)


# ---- evaluation tables --------------------------------------------------------------------


def eval_summary(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """F1 at 0.5, best F1 and threshold, counts and score moments for every run and dataset.

    Rows combine into score cells in one scan; every figure comes from one sweep over the cells.
    """
    return summary_from_cells(cut_lineage(score_cells(df, score, label, by)), by)


def summary_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``eval_summary`` of (by, score, n, pos, neg) cells; callers hand in written ones."""
    by = list(by)
    swept = threshold_sweep(cells, by)
    s, n = F.col("score"), F.col("n")
    called = s >= 0.5

    def total(c: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))

    # ascending position of a cell's first row = rows below it
    first, last = F.col("_all") - F.col("cum_n"), F.col("_all") - F.col("cum_n") + n
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    out = swept.groupBy(*by).agg(
        _best_cut(),
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos_true"),
        total("n", called).alias("pos_pred_at_0_5"),
        total("pos", called).alias("_tp"),
        total("neg", called).alias("_fp"),
        total("pos", ~called).alias("_fn"),
        (F.sum(s * n) / F.sum("n")).alias("prob_mean"),
        (F.sum(s * s * n) / F.sum("n")).alias("_sq"),
        F.max(F.when((first <= low) & (low < last), s)).alias("_lo"),
        F.max(F.when((first <= high) & (high < last), s)).alias("_hi"),
    )
    return out.select(
        *by, "n", "pos_true", "pos_pred_at_0_5",
        f1_from_counts(F.col("_tp"), F.col("_fp"), F.col("_fn")).alias("f1_at_0_5"),
        F.col("_b.f1").alias("best_f1"),
        _cut_threshold().alias("best_threshold"),
        "prob_mean",
        ((F.col("_lo") + F.col("_hi")) / 2.0).alias("prob_median"),
        F.sqrt(F.greatest(F.col("_sq") - F.col("prob_mean") * F.col("prob_mean"), F.lit(0.0))).alias("prob_std"),
    )


def distribution_report(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population std, linear percentiles and positives at 0.5."""
    by = list(by)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.count_if(F.col(score) >= 0.5).alias("pos_at_0_5"),
    )
    return _with_percentiles(base, exact_percentiles(df, score, DISTRIBUTION_POINTS, by), by)


DISTRIBUTION_POINTS = (0.1, 0.25, 0.5, 0.75, 0.9)


def distribution_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``distribution_report`` of (by, score, n) cells; a NULL score counts in ``n`` alone. Callers hand in written cells."""
    by = list(by)
    s, n = F.col("score"), F.col("n")
    scored = F.sum(F.when(s.isNotNull(), n))
    mean = F.sum(s * n) / scored
    base = cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(s * s * n) / scored - mean * mean, F.lit(0.0))).alias("std"),
        F.coalesce(F.sum(F.when(s >= 0.5, n)), F.lit(0)).alias("pos_at_0_5"),
    )
    return _with_percentiles(base, percentiles_from_cells(cells.where(s.isNotNull()), "score", DISTRIBUTION_POINTS, by), by)


def _with_percentiles(base: DataFrame, pct: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return base.join(pct, by)
    packed = pct.select(F.struct(*pct.columns).alias("p")).scalar()
    return base.withColumn("_p", packed).select("n", "mean", "std", "pos_at_0_5", "_p.*")


def distribution_at_threshold(
    df: DataFrame, score: str, other: DataFrame, label: str, by: Sequence[str] = (), other_score: str | None = None
) -> DataFrame:
    """``distribution_report`` with the best F1 threshold of another (labelled) table applied to this one.

    Adds the threshold, the positives at it and the share of positives among negatives at 0.5 and there.
    """
    by = list(by)
    best = best_threshold(other, other_score or score, label, by).select(*by, "threshold")
    cut = df.join(best, by) if by else df.withColumn("threshold", best.select("threshold").scalar())
    called = F.count_if(F.col(score) >= F.col("threshold"))
    at = cut.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.max("threshold").alias("threshold"), called.alias("pos_at_best"),
        F.try_divide(F.count_if(F.col(score) >= 0.5), F.count_if(F.col(score) < 0.5)).alias("ratio_at_0_5"),
        F.try_divide(called, F.count(F.lit(1)) - called).alias("ratio_at_best"),
    )
    report = distribution_report(df, score, by)
    return report.join(at, by) if by else report.crossJoin(at)


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts and densities of all ``bins``, empty ones included; the last includes its upper edge.

    Bin i begins at the edge ``low + i * (high - low) / bins`` as a double; the bin found by division
    is put right by one step where that edge lies on the other side of the value.
    """
    by = list(by)
    v = F.col(value)
    span = high - low

    def edge(i: Column) -> Column:
        return F.lit(low) + i * F.lit(span) / F.lit(bins)

    guess = F.least(F.floor((v - low) * bins / span), F.lit(bins - 1))
    slot = F.when(v < edge(guess), guess - 1).when((guess < bins - 1) & (v >= edge(guess + 1)), guess + 1).otherwise(guess)
    inside = df.where((v >= low) & (v <= high))
    counts = inside.groupBy(*by, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    on = F.col("bin") == F.col("_bin")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    whole = Window.partitionBy(*[f"_g{i}" for i in range(len(by))])
    n = F.coalesce("count", F.lit(0))
    density = n / (F.sum(n).over(whole) * F.lit(span / bins))
    filled = every.join(counts, on, "left")
    return filled.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], F.col("_bin").alias("bin"), n.alias("count"), density.alias("density"))


def rank_correlation(df: DataFrame, key: str, metric: str, truth: str) -> DataFrame:
    """Pearson correlation of average ranks over distinct keys; NULL below three."""
    rows = (
        df.where(F.col(metric).isNotNull() & F.col(truth).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(F.col(metric).alias("m"), F.col(truth).alias("t"))).alias("_s"))
        .select(key, F.col("_s.m").alias("_m"), F.col("_s.t").alias("_t"))
    )
    ranked = average_ranks(rows, {"_m": "_rm", "_t": "_rt"})
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr("_rm", "_rt")).alias("rank_corr")
    )


def grouped_rank_correlation(df: DataFrame, group: str, key: str, metric: str, truth: str) -> DataFrame:
    """Rank correlation inside each group of a small results table (one row per run and group)."""
    rows = (
        df.where(F.col(metric).isNotNull() & F.col(truth).isNotNull())
        .groupBy(group, key)
        .agg(F.min(F.struct(F.col(metric).alias("m"), F.col(truth).alias("t"))).alias("_s"))
        .select(group, F.col("_s.m").alias("_m"), F.col("_s.t").alias("_t"))
    )

    def avg_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(group).orderBy(c)) + (
            F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1
        ) / 2

    return (
        rows.withColumn("_rm", avg_rank("_m"))
        .withColumn("_rt", avg_rank("_t"))
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr("_rm", "_rt")).alias("rank_corr"))
    )


def pivot_runs(df: DataFrame, run: str, dataset: str, datasets: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide table with ``metric__dataset`` columns; every run stays, missing cells are NULL."""
    cells = [
        F.first(F.when(F.col(dataset) == d, F.col(m)), ignorenulls=True).alias(f"{m}__{d}") for d in datasets for m in metrics
    ]
    return df.groupBy(run).agg(*cells)


def weighted_loss(df: DataFrame, loss: Column, hit: Column, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean (weighted) loss and accuracy; the mean divides by rows, not by the weight total."""
    term = loss * weight if weight is not None else loss
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(term) / F.count(F.lit(1))).alias("loss"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def temperature_nll(
    df: DataFrame, score: str, label: str, grid: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Mean NLL of temperature-scaled probabilities at every grid temperature, in one scan."""
    p = clamp(F.col(score), 1e-7)
    logits = df.withColumn("_x", F.log(p / (1.0 - p)))
    w = F.col(weight) if weight else F.lit(1)
    terms = []
    for i, t in enumerate(grid):
        q = clamp(1.0 / (1.0 + F.exp(-(F.col("_x") / F.lit(float(t))))), 1e-7)
        terms.append((F.sum(-F.log(F.when(F.col(label) == 1, q).otherwise(1.0 - q)) * w) / F.sum(w)).alias(f"_{i}"))
    wide = logits.groupBy(*by).agg(*terms)
    pairs = F.array(
        *[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_{i}").alias("nll")) for i, t in enumerate(grid)]
    )
    return wide.select(*by, F.inline(pairs))


def fit_temperature(df: DataFrame, score: str, label: str, low: float = 0.1, high: float = 10.0, rounds: int = 4, points: int = 25) -> float:
    """Temperature with the lowest NLL on [low, high]: grids that narrow around the best point.

    The rows are scanned once, into (score, label) counts; the grids run on those.
    """
    cells = cut_lineage(df.groupBy(score, label).agg(F.count(F.lit(1)).alias("_n")))
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        nll = temperature_nll(cells, score, label, grid, weight="_n")
        at = nll.agg(F.min(F.struct("nll", "temperature")).alias("b")).first()["b"]["temperature"]
        low, high = max(low, at - step), min(high, at + step)
    return float(at)
