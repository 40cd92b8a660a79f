"""Thresholds, percentiles, ranks and calibration against brute force on small tables."""

import random

import numpy as np
import pandas as pd
import pytest

from sievecrest.operators import metrics as M
from sievecrest.operators import ordering as O
from pyspark.sql import functions as F


def f1(rows, t):
    tp = sum(1 for s, y in rows if s >= t and y == 1)
    fp = sum(1 for s, y in rows if s >= t and y == 0)
    fn = sum(1 for s, y in rows if s < t and y == 1)
    p, r = tp / max(1, tp + fp), tp / max(1, tp + fn)
    return 0.0 if p + r == 0 else 2.0 * p * r / (p + r)


def brute(rows, start):
    best_t, best = 0.5, start
    for t in sorted({0.0, 0.5, 1.0, *[s for s, _ in rows]}):
        v = f1(rows, t)
        if v > best:
            best_t, best = t, v
    return best_t, best


GROUPS = {
    "ties": [(0.2, 0), (0.2, 1), (0.7, 1), (0.7, 1), (0.9, 0)],
    "all_negative": [(0.1, 0), (0.6, 0)],
    "one_row": [(0.3, 1)],
    "on_half": [(0.5, 1), (0.49, 0), (0.51, 1)],
    "gap": [(0.3, 0), (0.8, 1), (0.95, 1)],
    "high": [(1.0, 1), (1.0, 1), (0.2, 0)],
    "random": [(random.Random(1).random(), i % 3 // 2) for i in range(5)]
    + [(round(random.Random(i).random(), 2), int(random.Random(i + 99).random() < 0.3)) for i in range(300)],
}


@pytest.mark.parametrize("start", [float("-inf"), -1.0, 0.0])
def test_best_threshold_equals_rescan(spark, start):
    df = spark.createDataFrame([(g, float(s), y) for g, rows in GROUPS.items() for s, y in rows], "g string, s double, y int")
    got = {r["g"]: (r["threshold"], r["best_f1"]) for r in M.best_threshold(df, "s", "y", ["g"], start).collect()}
    for g, rows in GROUPS.items():
        t, v = brute(rows, start)
        assert got[g][0] == pytest.approx(t), g
        assert got[g][1] == pytest.approx(v), g


def test_hot_value_and_partitions_do_not_change_running_totals(spark):
    rng = random.Random(5)
    vals = [0.25 if rng.random() < 0.4 else rng.random() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    cells = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    want = pd.Series(vals).value_counts().sort_index(ascending=False).cumsum()
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["v"]: r["cum_n"] for r in O.running_totals(cells, "v", ["n"]).collect()}
        assert got == {k: int(c) for k, c in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_percentiles_interpolate_like_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.random(101), "b": np.array([1.0, 2.0]), "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    for r in M.exact_percentiles(df, "x", [0.1, 0.5, 0.75], ["k"]).collect():
        assert [r["p10"], r["p50"], r["p75"]] == pytest.approx(list(np.percentile(data[r["k"]], [10, 50, 75])))


def test_average_rank_matches_pandas(spark):
    vals = [3.0, None, 1.0, 3.0, 2.0, None, 3.0]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    for asc in (True, False):
        got = [r["r"] for r in O.average_rank(df, "v", "r", pct=True, ascending=asc).orderBy("i").collect()]
        want = pd.Series(vals, dtype=float).rank(method="average", ascending=asc, na_option="bottom", pct=True)
        assert got == pytest.approx(want.tolist())


def test_global_row_number_spreads_ties_and_counts_groups(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", 0.5 if i % 2 else i / 400) for i in range(400)], "id int, g string, s double")
    got = O.global_row_number(df, [F.col("s").desc(), F.col("id").asc()], "rn", by=["g"], parts=7).toPandas()
    for g, part in got.groupby("g"):
        want = part.sort_values(["s", "id"], ascending=[False, True])["id"].tolist()
        assert part.sort_values("rn")["id"].tolist() == want
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))


def test_calibration_takes_first_nearest_grid_step(spark):
    probs = [0.0, 0.0001, 0.3, 0.3, 0.5, 0.95, 0.97]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    got = {r["target"]: (r["threshold"], r["positives"]) for r in M.calibrate_to_positive_count(df, "p", [0, 2, 4, 6, 100]).collect()}
    grid = np.linspace(1e-4, 0.95, 500)
    for target, (t, pos) in got.items():
        diffs = [abs(sum(p >= g for p in probs) - target) for g in grid]
        at = int(np.argmin(diffs))
        assert t == pytest.approx(grid[at]) and pos == sum(p >= grid[at] for p in probs)


def test_grid_counts_on_grid_points(spark):
    grid = np.linspace(1e-4, 0.95, 500)
    df = spark.createDataFrame([(float(g),) for g in grid], "p double")
    got = {r["step"]: r["positives"] for r in M.grid_positive_counts(df, "p").collect()}
    assert got == {i: int((grid >= grid[i]).sum()) for i in range(500)}


def test_rank_correlation_needs_three_runs(spark):
    df = spark.createDataFrame([("a", 0.1, 1.0), ("b", 0.2, 2.0)], "run string, m double, t double")
    assert M.rank_correlation(df, "run", "m", "t").first()["rank_corr"] is None
    more = df.union(spark.createDataFrame([("c", 0.3, 0.5)], "run string, m double, t double"))
    assert M.rank_correlation(more, "run", "m", "t").first()["rank_corr"] == pytest.approx(-0.5)


def test_strict_priors_fail_on_an_empty_class(spark):
    df = spark.createDataFrame([(1,), (1,)], "label int")
    with pytest.raises(Exception, match="one row of each class"):
        M.class_priors(df, strict=True).collect()


def test_temperature_fit_finds_the_minimum(spark):
    rng = random.Random(2)
    rows = [(1 / (1 + np.exp(-3.0 * z)), int(rng.random() < 1 / (1 + np.exp(-z)))) for z in (rng.gauss(0, 1.5) for _ in range(4000))]
    df = spark.createDataFrame([(float(p), y) for p, y in rows], "p double, y int").cache()
    assert M.fit_temperature(df, "p", "y") == pytest.approx(3.0, abs=0.4)


def test_epoch_selection_keeps_runs_apart(spark):
    from sievecrest.operators.ledger import epoch_selection

    rows = [(run, e, i, ((i * 37 + e * 11 + len(run)) % 100) / 100, i % 2, "search" if i % 3 else "select") for run in ("a", "bb") for e in range(1, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, epoch int, id int, prob double, label int, subset string")
    both = {(r.run, r.epoch): (r.threshold, r.val_f1, r.best_so_far) for r in epoch_selection(df, 0.5, 0.5, run="run").collect()}
    for run in ("a", "bb"):
        for r in epoch_selection(df.where(df.run == run).drop("run"), 0.5, 0.5).collect():
            assert both[run, r.epoch] == (r.threshold, r.val_f1, r.best_so_far)
