"""Models of many settings fitted together: every pass over the rows serves all of them.

Each setting has its own small optimiser on the driver, a generator that asks for loss and gradient at
a point. The points of all settings go out together, each task sums losses and gradients of its rows
for every point, and one row a setting comes back; passes follow the slowest setting, not their number.
What travels is parameters and their sums, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INIT_ROWS = 20_000
Solver = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


# ---- optimisers -----------------------------------------------------------------------------


def lbfgs(x: np.ndarray, max_iter: int, memory: int = 10, tol: float = 1e-9) -> Solver:
    """Limited-memory quasi-Newton steps with backtracking, until the gradient is below ``tol``."""
    loss, grad = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tol:
            break
        step = grad.copy()
        weights = []
        for s, y in reversed(past):
            weights.append((s @ step) / (s @ y))
            step -= weights[-1] * y
        if past:
            s, y = past[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), w in zip(past, reversed(weights)):
            step += (w - (y @ step) / (s @ y)) * s
        slope = -(grad @ step)
        size = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            ahead = x - size * step
            loss_ahead, grad_ahead = yield ahead
            if loss_ahead <= loss + 1e-4 * size * slope:
                break
            size /= 2
            if size < 1e-12:
                return x
        moved = (ahead - x, grad_ahead - grad)
        if moved[0] @ moved[1] > 1e-14:
            past = [*past[1 - memory :], moved] if len(past) >= memory else [*past, moved]
        x, loss, grad = ahead, loss_ahead, grad_ahead
    return x


def descent(x: np.ndarray, max_iter: int, step: float) -> Solver:
    """Plain gradient descent; the t-th step is divided by the root of t."""
    for t in range(1, max_iter + 1):
        _, grad = yield x
        x = x - step / np.sqrt(t) * grad
    return x


def solve_together(evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], solvers: Sequence[Solver]) -> tuple[list[np.ndarray], int]:
    """What every solver returns, and how many times all open points were evaluated."""
    found: list = [None] * len(solvers)
    answers: dict = dict.fromkeys(range(len(solvers)))
    passes = 0
    while answers:
        points = {}
        for i, answer in answers.items():
            try:
                points[i] = solvers[i].send(answer)
            except StopIteration as end:
                found[i] = end.value
        answers = evaluate(points) if points else {}
        passes += bool(points)
    return found, passes


# ---- networks with a logistic output ----------------------------------------------------------


class Network:
    """Sigmoid hidden layers and one logistic output; without hidden layers it is logistic regression."""

    def __init__(self, dims: int, hidden: Sequence[int] = ()):
        sizes = [dims, *hidden, 1]
        self.shapes = list(zip(sizes, sizes[1:]))

    def start(self, seed: int | None) -> np.ndarray:
        """Random weights, or zeros where there is nothing to break ties between."""
        if seed is None or len(self.shapes) == 1:
            return np.zeros(sum((a + 1) * b for a, b in self.shapes))
        rnd = np.random.default_rng(seed)
        return np.concatenate([np.append(rnd.standard_normal(a * b) / np.sqrt(a), np.zeros(b)) for a, b in self.shapes])

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def penalised(self, flat: np.ndarray) -> np.ndarray:
        """The weights alone: biases carry no penalty."""
        return np.concatenate([np.append(w.ravel(), np.zeros(len(b))) for w, b in self.layers(flat)])

    def _forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        values = [x]
        layers = self.layers(flat)
        for i, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            values.append(z if i == len(layers) - 1 else 1 / (1 + np.exp(-z)))
        return values

    def probability(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(flat, x)[-1][:, 0]))

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted sum of log losses, and its gradient."""
        values = self._forward(flat, x)
        z = values[-1][:, 0]
        total = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        back = (weight * (1 / (1 + np.exp(-z)) - y))[:, None]
        grads = []
        for (w, _), value in zip(reversed(self.layers(flat)), reversed(values[:-1])):
            grads.append(np.append((value.T @ back).ravel(), back.sum(axis=0)))
            back = (back @ w.T) * value * (1 - value)
        return total, np.concatenate(grads[::-1])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def fit_networks(
    rows: DataFrame, networks: Sequence[Network], starts: Sequence[np.ndarray], solvers: Sequence[Callable[[np.ndarray], Solver]], penalties: Sequence[float]
) -> tuple[list[np.ndarray], int]:
    """Parameters of every network, fitted together on (``_v`` array, ``_y``, ``weight``) rows, and the passes taken.

    Minimised is the weighted mean of log losses plus half the penalty times the squared weights. ``rows``
    must be a written table: each pass reads it.
    """
    total = rows.agg(F.sum("weight")).first()[0] or 1.0

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {i: np.zeros(len(p) + 1) for i, p in points.items()}
            for batch in batches:
                if not len(batch):
                    continue
                x, y, w = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for i, p in points.items():
                    loss, grad = networks[i].loss(p, x, y, w)
                    sums[i] += np.append(loss, grad)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()])], ["setting", "s"])

        summed = rows.select("_v", "_y", "weight").mapInArrow(work, "setting int, s array<double>")
        by_setting = summed.groupBy("setting").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        out = {}
        for r in by_setting.collect():  # one row a setting
            i, s = r["setting"], np.array(r["s"])
            kept = networks[i].penalised(points[i])
            out[i] = (s[0] / total + penalties[i] / 2 * (kept @ kept), s[1:] / total + penalties[i] * kept)
        return {i: out.get(i, (0.0, np.zeros(len(p)))) for i, p in points.items()}

    return solve_together(evaluate, [solve(start) for solve, start in zip(solvers, starts)])


def probabilities(networks: Sequence[Network], fitted: Sequence[np.ndarray], vector: str | Column) -> Column:
    """Array with the probability of every fitted network, from one pass over the vectors."""

    @F.pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(list(np.stack([n.probability(p, x) for n, p in zip(networks, fitted)], axis=1)))

    return score(vector)


# ---- k-means ------------------------------------------------------------------------------------


def _spread_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` rows, each drawn by its squared distance to those before it."""
    rnd = np.random.default_rng(seed)
    centres = [x[rnd.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        pick = rnd.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rnd.integers(len(x))
        centres.append(x[pick])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row (the first of equals) and the squared distance."""
    gap = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    nearest = gap.argmin(axis=1)
    return nearest, ((x - centres[nearest]) ** 2).sum(axis=1)


def kmeans_together(
    rows: DataFrame, k: int, seeds: Sequence[int], max_iter: int = 50, tol: float = 1e-4, least_gain: float = 1e-5, init_rows: int = INIT_ROWS
) -> tuple[np.ndarray, float, int]:
    """(centres, cost, passes) of the best of several runs of k-means on a written table with ``_v`` arrays.

    Every pass assigns all rows to the centres of all runs still moving and sums them by centre.
    A run ends when no centre moves by ``tol`` or its cost falls by less than a share ``least_gain``. First
    centres are drawn by distance from the ``init_rows`` rows of least hash, a bounded sample; all passes
    read all rows. Equal runs are settled by the order of the seeds; an empty cluster keeps its centre.
    """
    first = rows.select("_v").orderBy(F.xxhash64("_v"), "_v").limit(init_rows).toPandas()
    x = np.stack(first["_v"].to_numpy())
    centres = {s: _spread_centres(x, k, seed) for s, seed in enumerate(seeds)}
    cost = dict.fromkeys(centres, np.inf)
    open_, passes = set(centres), 0
    dims = x.shape[1]

    def sums(asked: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: np.zeros(k * (dims + 1) + 1) for s in asked}
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch.column(0))
                for s, c in asked.items():
                    near, gap = _nearest(x, c)
                    order = np.argsort(near, kind="stable")
                    at = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
                    which = near[order][at]
                    grid = held[s][:-1].reshape(k, dims + 1)
                    grid[which, :dims] += np.add.reduceat(x[order], at, axis=0)
                    grid[which, dims] += np.diff(np.append(at, len(order)))
                    held[s][-1] += gap.sum()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tolist() for h in held.values()])], ["run", "s"])

        summed = rows.select("_v").mapInArrow(work, "run int, s array<double>")
        out = {}
        for r in summed.groupBy("run").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect():
            s = np.array(r["s"])
            grid = s[:-1].reshape(k, dims + 1)
            out[r["run"]] = grid[:, :dims], grid[:, dims], float(s[-1])
        return out

    for step in range(max_iter + 1):
        if not open_:
            break
        passes += 1
        for s, (total, n, spent) in sums({s: centres[s] for s in sorted(open_)}).items():
            gained, cost[s] = cost[s] - spent, spent
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[s])
            still = ((moved - centres[s]) ** 2).sum(axis=1).max() <= tol**2 or gained <= least_gain * spent
            if still or step == max_iter:
                open_.discard(s)
            else:
                centres[s] = moved
    best = min(centres, key=lambda s: (cost[s], s))
    return centres[best], cost[best], passes


def nearest_centre(centres: np.ndarray, vector: str | Column) -> Column:
    """Number of the nearest centre."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series(_nearest(np.stack(vectors.to_numpy()).astype(np.float64), centres)[0].astype("int32"))

    return nearest(vector)
