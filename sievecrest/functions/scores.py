"""Column expressions on probabilities, logits and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecrest.functions.vectors import let


def clamp(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps)
    return F.log(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _prior_logit(pi: Column | float, eps: float) -> Column:
    if isinstance(pi, Column):
        return logit(pi, eps)
    q = min(max(float(pi), eps), 1.0 - eps)
    return F.lit(math.log(q / (1.0 - q)))


def bayes_prior_correct(p: Column, train_pi: Column | float, target_pi: Column | float, eps: float = 1e-6) -> Column:
    """Move a probability from the training prior to the target prior in logit space."""
    return sigmoid(logit(p, eps) + (_prior_logit(target_pi, eps) - _prior_logit(train_pi, eps)))


def confidence(p: Column) -> Column:
    return F.when(p >= 0.5, p).otherwise(1.0 - p)


def low_confidence(p: Column, clip: bool = True) -> Column:
    gap = F.abs(p - 0.5)
    if clip:
        gap = F.least(F.greatest(gap, F.lit(0.0)), F.lit(0.5))
    return 1.0 - gap * 2.0


def threshold_label(p: Column, t: Column | float) -> Column:
    return (p >= t).cast("int")


def _shifted_exps(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, index: int | None = None) -> Column:
    """Softmax of an array of logits (max-shifted); one entry when ``index`` is given."""

    def finish(exps: Column) -> Column:
        if index is not None:
            return F.element_at(exps, index + 1) / _total(exps)
        return let(_total(exps), lambda total: F.transform(exps, lambda x: x / total))

    return let(_shifted_exps(logits), finish)


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_softmax(logits: Column) -> Column:
    shift = F.array_max(logits) + F.log(_total(_shifted_exps(logits)))
    return let(shift, lambda by: F.transform(logits, lambda x: x - by))


def smoothed_target(label: Column, classes: int = 2, smoothing: float = 0.0) -> Column:
    hit = F.array(*[(label == c).cast("double") for c in range(classes)])
    if smoothing <= 0.0:
        return hit
    return F.transform(hit, lambda x: x * (1.0 - smoothing) + smoothing / classes)


def soft_cross_entropy(
    logits: Column, target: Column, class_weights: list[float] | None = None, sample_weight: Column | None = None
) -> Column:
    lp = log_softmax(logits)
    if class_weights:
        lp = F.zip_with(lp, F.array(*[F.lit(float(w)) for w in class_weights]), lambda a, w: a * w)
    loss = -F.aggregate(F.zip_with(target, lp, lambda t, x: t * x), F.lit(0.0), lambda a, x: a + x)
    return loss * sample_weight if sample_weight is not None else loss


def focal_loss(
    logits: Column,
    label: Column,
    alpha: float = 0.25,
    gamma: float = 2.0,
    class_weights: list[float] | None = None,
    sample_weight: Column | None = None,
) -> Column:
    """Focal loss of an integer label; ``alpha`` weights class 1, ``1 - alpha`` the others."""
    p = F.element_at(softmax(logits), label + 1)
    ce = -F.element_at(log_softmax(logits), label + 1)
    if class_weights:
        ce = ce * F.element_at(F.array(*[F.lit(float(w)) for w in class_weights]), label + 1)
    focus = F.pow(1.0 - p, F.lit(gamma))
    if alpha != 1.0:
        focus = focus * F.when(label == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    loss = focus * ce
    return loss * sample_weight if sample_weight is not None else loss
