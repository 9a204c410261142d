"""Guarded arithmetic, clipping and right-closed bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SENTINEL = -999.0
RATIO_EPS = 1e-9


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def guarded_ratio(num: Column, den: Column, eps: float = RATIO_EPS) -> Column:
    """``num / den`` only where ``|den| > eps``; null elsewhere."""
    return F.when(F.abs(den) > eps, ratio(num, den))


def shifted_ratio(num: Column, den: Column, shift: float = 1.0) -> Column:
    """``num / (den + shift)``."""
    return ratio(num, den + F.lit(shift))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def fill(x: Column, value: float = SENTINEL) -> Column:
    """Null, NaN and both infinities become ``value``."""
    d = x.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(value)).otherwise(d)


def fill_infinite(x: Column, value: float = SENTINEL) -> Column:
    """Only the infinities become ``value``; null and NaN stay."""
    d = x.cast("double")
    return F.when(F.abs(d) == F.lit(float("inf")), F.lit(value)).otherwise(d)


def coerce(x: Column) -> Column:
    """Text to number; what does not parse, and every non-finite number, becomes 0."""
    d = x.try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(d)


def right_closed_bin(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]``; null outside all of them."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out
