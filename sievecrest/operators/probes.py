"""Linear and small neural probes on embedding tables, stacking, and batch scoring with a user model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecrest.functions.scores import clamp, sigmoid
from sievecrest.operators.batched import Network, Solver, descent, fit_networks, lbfgs, probabilities
from sievecrest.operators.clusters import standardise
from sievecrest.operators.metrics import best_threshold, f1_at
from sievecrest.session import cut_lineage


def balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (2 * n_class)`` as a weight column."""
    counts = df.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    ).scalar()
    share = F.when(F.col(label) == 1, F.col("_c.p")).otherwise(F.col("_c.q"))
    return df.withColumn("_c", counts).withColumn("weight", F.col("_c.n") / (2.0 * share)).drop("_c")


def logistic_probe(
    train: DataFrame, others: DataFrame, c_values: Sequence[float], vector: str = "embedding", label: str = "label", balanced: bool = True
) -> DataFrame:
    """Probabilities of ``others`` under an L2 logistic probe for every C: rows + (C, prob_pos).

    Standardised on the training rows; penalty ``1 / (C * n)`` on the mean loss. Training rows are
    written once; every pass over them serves the fits of all C, and one pass scores all of them.
    """
    train = train.where(F.col(label).isNotNull())
    fit = balanced_weight(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    fit = standardise(fit, train, vector).select(F.col(vector).alias("_v"), F.col(label).cast("double").alias("_y"), F.col("weight").cast("double"))
    fit = cut_lineage(fit)
    n = max(1, fit.count())
    networks = [Network(fit.select(F.size("_v")).first()[0])] * len(c_values)
    starts = [networks[0].start(None)] * len(c_values)
    fitted, _ = fit_networks(fit, networks, starts, [lambda x: lbfgs(x, 200)] * len(c_values), [1.0 / (c * n) for c in c_values])
    scored = standardise(others, train, vector).withColumn("_p", probabilities(networks, fitted, vector))
    named = F.arrays_zip(F.array(*[F.lit(float(c)) for c in c_values]).alias("C"), F.col("_p").alias("prob_pos"))
    kept = [c for c in others.columns if c not in ("prob_pos", "C")]
    return scored.withColumn("_s", F.explode(named)).select(*kept, "_s.prob_pos", "_s.C")


def mlp_probe(
    train: DataFrame, others: DataFrame, hidden: Sequence[int] = (32,), vector: str = "embedding", label: str = "label", seed: int = 42, max_iter: int = 60
) -> DataFrame:
    """Probabilities of ``others`` under a small network with sigmoid hidden layers."""
    train = train.where(F.col(label).isNotNull())
    fit = cut_lineage(standardise(train, train, vector).select(F.col(vector).alias("_v"), F.col(label).cast("double").alias("_y"), F.lit(1.0).alias("weight")))
    network = Network(fit.select(F.size("_v")).first()[0], hidden)
    fitted, _ = fit_networks(fit, [network], [network.start(seed)], [lambda x: lbfgs(x, max_iter)], [0.0])
    return standardise(others, train, vector).withColumn("prob_pos", probabilities([network], fitted, vector)[0])


def mlp_sweep(
    train: DataFrame, val: DataFrame, hidden: Sequence[Sequence[int]], iterations: Sequence[int] = (60,), steps: Sequence[float | None] = (None,),
    seeds: Sequence[int] = (42,), vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Network settings judged on ``val``: (hidden, iterations, step_size, seed, f1_at_half, threshold, best_f1).

    A step size takes plain gradient descent, which uses it; without one the solver is l-bfgs, which
    has none. All settings are fitted together, every pass over the written rows serving each of them;
    one pass scores them and one sweep finds their thresholds.
    """
    spark = train.sparkSession
    train, val = train.where(F.col(label).isNotNull()), val.where(F.col(label).isNotNull())
    fit = cut_lineage(standardise(train, train, vector).select(F.col(vector).alias("_v"), F.col(label).cast("double").alias("_y"), F.lit(1.0).alias("weight")))
    dims = fit.select(F.size("_v")).first()[0]
    settings = [(tuple(h), n, step, seed) for h in hidden for n in iterations for step in steps for seed in seeds]
    networks = [Network(dims, h) for h, *_ in settings]
    starts = [n.start(seed) for n, (*_, seed) in zip(networks, settings)]

    def solver(n: int, step: float | None) -> Callable[[np.ndarray], Solver]:
        return lambda x: lbfgs(x, n) if step is None else descent(x, n, step)

    fitted, _ = fit_networks(fit, networks, starts, [solver(n, step) for _, n, step, _ in settings], [0.0] * len(settings))
    judge = standardise(val, train, vector).select(F.col(label).alias("label"), probabilities(networks, fitted, vector).alias("_p"))
    scored = cut_lineage(judge.select("label", F.posexplode("_p").alias("setting", "prob_pos")))
    half = f1_at(scored, "prob_pos", "label", 0.5, ["setting"]).select("setting", F.col("f1").alias("f1_at_half"))
    best = best_threshold(scored, "prob_pos", "label", ["setting"])
    rows = [(i, ",".join(map(str, h)), n, step, seed) for i, (h, n, step, seed) in enumerate(settings)]
    named = spark.createDataFrame(rows, "setting int, hidden string, iterations int, step_size double, seed int")
    return named.join(half, "setting").join(best, "setting").drop("setting").orderBy(F.desc("best_f1"), "hidden", "iterations", "step_size", "seed")


def temperature_calibrated(p: Column, temperature: float, eps: float = 1e-7) -> Column:
    q = clamp(p, eps)
    return sigmoid(F.log(q / (1.0 - q)) / F.lit(float(temperature)))


def stacking_features(a: Column, b: Column) -> Column:
    """Two calibrated probabilities -> six meta features."""
    return F.array(a, b, a * b, F.abs(a - b), (a + b) / 2.0, F.when(a > 0.5, a).otherwise(F.lit(0.0)))


def stack_models(val: DataFrame, test: DataFrame, a: str, b: str, label: str, t_a: float, t_b: float, c: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Meta probabilities of validation and test rows from a balanced logistic stacker.

    Temperatures come from validation and are reused on the test rows.
    """

    def features(df: DataFrame) -> DataFrame:
        return df.withColumn("meta", stacking_features(temperature_calibrated(F.col(a), t_a), temperature_calibrated(F.col(b), t_b)))

    train = features(val)
    score = features(val.withColumn("_set", F.lit("val"))).unionByName(features(test.withColumn("_set", F.lit("test"))), allowMissingColumns=True)
    out = cut_lineage(logistic_probe(train, score, [c], "meta", label).drop("meta", "C"))
    return out.where("_set = 'val'").drop("_set"), out.where("_set = 'test'").drop("_set")


def auc(df: DataFrame, prob: str = "prob_pos", label: str = "label") -> float:
    rows = df.select(F.col(prob).alias("p"), F.col(label).cast("double").alias("y"))
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y").evaluate(rows)


def batch_score(df: DataFrame, make_predict_fn: Callable, vector: str = "embedding", name: str = "prob_pos", batch_size: int = 1024) -> DataFrame:
    """Score vectors in Arrow batches with a model each Python worker loads once."""
    dims = df.select(F.size(vector)).first()[0]
    fn = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[dims]])
    return df.withColumn(name, fn(F.col(vector)))


def linear_model(weights: Sequence[float], bias: float = 0.0) -> Callable:
    """A model factory for ``batch_score``: logistic of a fixed linear form."""

    def load():
        w = np.asarray(weights, dtype=np.float64)

        def predict(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-(x.astype(np.float64) @ w + bias)))

        return predict

    return load
