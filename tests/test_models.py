"""Projection, clusters, probes, stacking and the validation builder on planted data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecrest.functions import risk as R
from sievecrest.operators import clusters as C
from sievecrest.operators import images as I
from sievecrest.operators import neighbours as N
from sievecrest.operators import probes as PB
from sievecrest.plans import validation as VL


@pytest.fixture(scope="module")
def blobs(spark):
    """Three far-apart groups in eight dimensions; the first two are labels 0 and 1."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 8)) * 6
    rows = []
    for i in range(180):
        g = i % 3
        source = ("train", "myval", "test")[i // 3 % 3]
        vec = (centres[g] + rng.standard_normal(8)).tolist()
        rows.append((f"s{i}", source, None if source == "test" or g == 2 and i % 2 else min(g, 1), g, vec))
    return spark.createDataFrame(rows, "sample_id string, source string, label int, g int, embedding array<double>").cache()


def test_projection_matches_numpy(blobs):
    z = C.standardise(blobs, blobs)
    p = C.project(z, z, 3)
    x = np.array([r.embedding for r in z.orderBy("sample_id").collect()])
    y = np.array([r.embedding for r in p.orderBy("sample_id").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ axes[:, ::-1][:, :3])
    assert np.allclose(np.abs(y), want, atol=1e-6)
    assert np.allclose(y.var(axis=0, ddof=1), values[::-1][:3])


def test_clusters_find_planted_groups(blobs):
    got = C.kmeans_labels(blobs, blobs, 3, seeds=(1, 2, 3)).groupBy("g").agg(F.count_distinct("cluster").alias("n"), F.min("cluster").alias("c")).collect()
    assert all(r.n == 1 for r in got) and len({r.c for r in got}) == 3


def test_probes_separate_planted_labels(blobs):
    two = blobs.where("g < 2 AND label IS NOT NULL")
    train, val = two.where("source = 'train'"), two.where("source = 'myval'")
    logistic = PB.logistic_probe(train, val, [0.1, 1.0]).collect()
    assert {r.C for r in logistic} == {0.1, 1.0} and all((r.prob_pos > 0.5) == (r.label == 1) for r in logistic)
    assert all((r.prob_pos > 0.5) == (r.label == 1) for r in PB.mlp_probe(train, val, (4,), max_iter=40).collect())


def test_logistic_probe_is_at_its_optimum(spark):
    """The gradient of mean weighted loss plus the penalty is zero there."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 3))
    y = (x[:, 0] + 0.8 * rng.standard_normal(120) > 0.3).astype(int)
    df = spark.createDataFrame([(i, int(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y))], "id int, label int, embedding array<double>")
    p = np.array([r.prob_pos for r in PB.logistic_probe(df, df, [0.5]).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    logit = np.log(p / (1 - p))
    beta = np.linalg.lstsq(np.c_[z, np.ones(len(y))], logit, rcond=None)[0]
    gradient = z.T @ (w * (p - y)) / w.sum() + beta[:3] / (0.5 * len(y))
    assert np.abs(gradient).max() < 1e-3 and abs((w * (p - y)).sum()) < 1e-2


def test_sweep_settings_act(blobs):
    two = blobs.where("label IS NOT NULL")
    got = PB.mlp_sweep(two.where("source = 'train'"), two.where("source = 'myval'"), [(3,)], (1, 40), (None, 1e-6, 0.5)).collect()
    by = {(r.iterations, r.step_size): r for r in got}
    assert len(by) == 6 and by[40, None].best_f1 >= max(r.best_f1 for r in got) - 1e-9
    assert len({(round(r.f1_at_half, 6), round(r.threshold, 6)) for r in got}) > 2


def test_stacking_beats_either_input(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.5)
        a, b = (1 / (1 + math.exp(-((2 * y - 1) * 1.2 + rng.standard_normal() * 1.5))) for _ in range(2))
        rows.append((i, y, a, b))
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    val, test = PB.stack_models(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "a", "b", "label", 1.0, 1.0)
    assert val.count() == test.count() == 200
    assert PB.auc(test) > max(PB.auc(df.where("id % 2 = 1"), p) for p in "ab") - 0.01


def test_validation_builder_with_exact_and_approximate_neighbours(blobs):
    names = ["train", "myval", "test"]
    exact = VL.test_like_scores(blobs, names, names, components=4, clusters=3, top_k=5)
    rows = exact.collect()
    assert len(rows) == 180
    for r in rows[:20]:
        want = R.test_like_score(F.lit(r.topk_mean), F.lit(r.centroid_cos), F.lit(r.cluster_test_fraction))
        assert r.test_like_score == pytest.approx(blobs.select(want.alias("x")).first().x)
    near = VL.test_like_scores(
        blobs, names, names, components=4, clusters=3, top_k=5, find=lambda q, r, k: N.approx_knn(q, r, k, 0.8)
    ).collect()
    close = {r.sample_id: r.topk_max for r in rows}
    assert sum(abs(close[r.sample_id] - r.topk_max) < 1e-6 for r in near) >= 0.95 * len(near)
    sets = VL.validation_sets(exact, ["train", "myval"], 20)
    sizes = {r.kind: r.n for r in sets.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).where("n = d").collect()}
    assert sizes["top"] == sizes["cluster"] == 20 and sizes["weighted"] > 20
    summary = VL.build_summary(exact, sets).first()
    assert summary.feature_rows == 180 and summary.anchor_rows == 60 and summary.set_rows["top"] == 20


def test_sign_candidates_are_few_and_find_close_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 32))
    y = x + 0.2 * rng.standard_normal(x.shape)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = unit(x), unit(y)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "l int, u array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "r int, u array<double>")
    pairs = {(p.l, p.r) for p in N.sign_candidates(left, right, 0.95).collect()}
    close = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= 0.95))}
    assert len(close) > 1000 and len(pairs & close) >= 0.95 * len(close)
    assert len(pairs) < 0.1 * 1500 * 1500


def test_statistics_vector_matches_its_definition():
    rng = np.random.default_rng(11)
    stack = rng.integers(0, 256, (3, 64, 64, 3)).astype(float)
    got = I.stats_matrix(stack)
    for image, row in zip(stack / 255.0, got):
        want = [np.histogram(image[:, :, c], 24, (0, 1), density=True)[0] for c in range(3)]
        high, low = image.max(axis=2), image.min(axis=2)
        sat = np.where(high > 1e-6, (high - low) / np.maximum(high, 1e-6), 0)
        want += [np.histogram(p, 16, (0, 1), density=True)[0] for p in (sat, high)]
        assert np.allclose(row[:104], np.concatenate(want))
        grey = image @ [0.299, 0.587, 0.114]
        first = row[104 + 784 :][:2]
        assert np.allclose(first, [grey[:16, :16].mean(), grey[:16, :16].std()])
    assert got.shape == (3, 104 + 784 + 3 * 16 * 2)
