"""Error measures as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_low(c: Column, low: float = 0.0) -> Column:
    return F.greatest(c, F.lit(low))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def residual(y: Column | str, p: Column | str) -> Column:
    """Prediction minus actual: positive where the forecast is too high."""
    return _col(p).cast("double") - _col(y).cast("double")


def rmse(y: Column | str, p: Column | str) -> Column:
    r = residual(y, p)
    return F.sqrt(F.avg(r * r))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(residual(y, p)))
