"""Ensemble search over shared partial sums against every combination on its own."""

from itertools import combinations

import numpy as np
import pytest

from sievecrest.operators import pooling as P

rng = np.random.default_rng(7)


def long_rows(n=160, models="dbca"):
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4) if i % 11 else None
        for m in models:
            if rng.random() < 0.95:
                p = None if rng.random() < 0.03 else float(round(rng.random(), 2))
                rows.append((["x", "y", None][i % 3], i, label, m, p))
    return rows


def f1(scores, labels, cut):
    called = scores >= cut
    tp, fp, fn = ((called & (labels == 1)).sum(), (called & (labels == 0)).sum(), (~called & (labels == 1)).sum())
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def test_search_equals_each_combination(spark):
    rows = long_rows()
    df = spark.createDataFrame(rows, "dataset string, id int, label int, model string, prob double").repartition(3)
    got = {(r.dataset, r.ensemble): r for r in P.ensemble_search(df, "dataset", "id", "label", 2, 3).collect() if r.dataset is not None}
    by_id = {}
    for d, i, label, m, p in rows:
        by_id.setdefault((d, i, label), {})[m] = p
    seen = 0
    for size in (2, 3):
        for combo in combinations("abcd", size):
            for d in ("x", "y"):
                rated = [(sum(v[m] for m in combo) / size, k[2]) for k, v in by_id.items() if k[0] == d and all(v.get(m) is not None for m in combo)]
                scores = np.array([s for s, _ in rated])
                labels = np.array([-1 if l is None else l for _, l in rated])
                r = got[d, " + ".join(combo)]
                best = max(f1(scores, labels, c) for c in {*scores, 0.0, 0.5, 1.0})
                assert (r.n_models, r.prob_mean) == (size, pytest.approx(scores.mean()))
                assert r.f1_at_0_5 == pytest.approx(f1(scores, labels, 0.5)) and r.best_f1 == pytest.approx(best)
                assert f1(scores, labels, r.best_threshold) == pytest.approx(best)
                seen += 1
    assert len(got) == seen == 20


def test_cells_hold_no_row_per_combination(spark):
    """Equal scores of a block leave as one cell, with the groups of a null data set kept."""
    df = spark.createDataFrame([(None, 1, [0.25, 0.75]), (None, 0, [0.75, 0.25]), ("a", 1, [0.5, None])], "d string, label int, v array<double>")
    got = P.combination_cells(df.coalesce(1), "d", "label", "v", [(0,), (0, 1)]).collect()
    assert sorted((str(r.d), r.combo, r.score, r.n, r.pos, r.neg) for r in got) == [
        ("None", 0, 0.25, 1, 1, 0), ("None", 0, 0.75, 1, 0, 1), ("None", 1, 0.5, 2, 1, 1), ("a", 0, 0.5, 1, 1, 0),
    ]


def test_one_model_has_no_ensembles(spark):
    df = spark.createDataFrame([("x", 1, 1, "a", 0.5)], "dataset string, id int, label int, model string, prob double")
    assert P.ensemble_search(df, "dataset", "id", "label").count() == 0
    assert P.ensemble_search(df.limit(0), "dataset", "id", "label").count() == 0
