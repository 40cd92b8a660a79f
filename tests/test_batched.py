"""Models fitted together: the same optimum as one by one, passes that do not grow with the settings."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from sievecrest.operators import batched as B

rng = np.random.default_rng(5)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    x = rng.standard_normal((600, 5))
    y = (x @ [2, -1, 0, 0.5, 0] + rng.standard_normal(600) > 0.3).astype(float)
    w = rng.uniform(0.5, 2, 600)
    path = str(tmp_path_factory.mktemp("rows") / "t")
    rows = [(v.tolist(), float(t), float(u)) for v, t, u in zip(x, y, w)]
    spark.createDataFrame(rows, "_v array<double>, _y double, weight double").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def fit(rows, penalties):
    nets = [B.Network(5)] * len(penalties)
    return B.fit_networks(rows, nets, [nets[0].start(None)] * len(penalties), [lambda x: B.lbfgs(x, 200)] * len(penalties), penalties)


def test_logistic_fits_share_passes_and_reach_the_optimum(planted):
    penalties = [0.3, 0.03, 0.003, 0.0003]
    together, passes = fit(planted, penalties)
    assert passes <= 40
    vectors = planted.select(array_to_vector("_v").alias("v"), "_y", "weight")
    for p, found in ((0.3, together[0]), (0.003, together[2])):
        model = LogisticRegression(featuresCol="v", labelCol="_y", weightCol="weight", regParam=p, standardization=False, tol=1e-10, maxIter=500).fit(vectors)
        assert np.allclose(found, [*model.coefficients, model.intercept], atol=1e-5)


def test_gradients_are_derivatives():
    net = B.Network(3, (4, 2))
    at = net.start(1) + 0.1
    x, y, w = rng.standard_normal((20, 3)), (rng.random(20) < 0.5).astype(float), rng.uniform(0.5, 2, 20)
    _, grad = net.loss(at, x, y, w)
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-6
        slope = (net.loss(at + step, x, y, w)[0] - net.loss(at - step, x, y, w)[0]) / 2e-6
        assert slope == pytest.approx(grad[i], abs=1e-5)


def test_passes_follow_the_slowest_setting(spark):
    asked = []

    def evaluate(points):
        asked.append(sorted(points))
        return {i: (float(p @ p), 2 * p) for i, p in points.items()}

    found, passes = B.solve_together(evaluate, [B.descent(np.ones(2), n, 0.1) for n in (1, 5, 3, 0)])
    assert passes == 5 and asked == [[0, 1, 2], [1, 2], [1, 2], [1], [1]] and found[3].tolist() == [1.0, 1.0]


def test_runs_of_kmeans_share_passes(spark, tmp_path):
    centres = rng.uniform(-20, 20, (6, 3))
    x = np.concatenate([c + rng.standard_normal((50, 3)) for c in centres])
    spark.createDataFrame([(v.tolist(),) for v in x], "_v array<double>").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    found, cost, passes = B.kmeans_together(rows, 6, range(42, 52))
    vectors = rows.select(array_to_vector("_v").alias("v"))
    single = min(KMeans(k=6, seed=s, featuresCol="v").fit(vectors).summary.trainingCost for s in range(42, 46))
    assert cost <= single * 1.001 and passes <= 51
    near, gap = B._nearest(x, found)
    assert gap.sum() == pytest.approx(cost) and len(set(near)) == 6
    got = rows.select("_v", B.nearest_centre(found, "_v").alias("c")).collect()
    assert all(r.c == np.argmin(((found - r._v) ** 2).sum(axis=1)) for r in got)


def test_kmeans_with_fewer_distinct_rows_than_centres(spark, tmp_path):
    spark.createDataFrame([([1.0],), ([1.0],), ([2.0],)], "_v array<double>").write.parquet(str(tmp_path / "t"))
    found, cost, _ = B.kmeans_together(spark.read.parquet(str(tmp_path / "t")), 3, [1, 2])
    assert cost == 0 and len(found) == 3
