"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``; inside another lambda it would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(a: Column, floor: float = 1e-8) -> Column:
    return let(F.greatest(norm(a), F.lit(floor)), lambda length: F.transform(a, lambda x: x / length))


def round_half_up(a: Column, digits: int) -> Column:
    """Elements scaled, rounded half away from zero and scaled back; what rounds to zero keeps its sign, as in IEEE and SQL engines."""
    scale = F.lit(10.0**digits)
    return F.transform(a, lambda x: F.round(F.abs(x) * scale) / scale * F.signum(x))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def zscore(a: Column, floor: float = 1e-6) -> Column:
    """Centre and divide by the population deviation; flat vectors are only centred."""

    def scaled(centred: Column) -> Column:
        sd = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x) / F.size(centred))
        return let(F.when(sd > floor, sd).otherwise(1.0), lambda by: F.transform(centred, lambda x: x / by))

    return let(let(mean(a), lambda m: F.transform(a, lambda x: x - m)), scaled)


def correlation_distance(a: Column, b: Column) -> Column:
    """``1 - dot / size`` of z-scored vectors."""
    return 1.0 - dot(a, b) / F.size(a)
