"""Calendar arithmetic on reference dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def back(ref: Column, amount: int, unit: str = "month") -> Column:
    """``ref`` moved back; months clamp to the month end (2000-03-31 minus one month is 2000-02-29)."""
    return F.add_months(ref, -amount) if unit == "month" else F.date_sub(ref, amount)


@dataclass(frozen=True)
class Window:
    """A look-back window ``(ref - start, ref - stop]`` in months or days.

    ``closed`` says which border day belongs to it: ``right`` (the default), ``left`` or ``both``.
    """

    start: int
    stop: int = 0
    closed: str = "right"
    unit: str = "month"

    def holds(self, date: Column, ref: Column) -> Column:
        lo = back(ref, self.start, self.unit)
        hi = back(ref, self.stop, self.unit) if self.stop else ref
        above = date >= lo if self.closed in ("left", "both") else date > lo
        below = date < hi if self.closed == "left" else date <= hi
        return above & below


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM").cast("date")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_number(date: Column) -> Column:
    """Months since year 0, so that differences are month distances."""
    return F.year(date) * 12 + F.month(date)


def month_range(first: Column, last: Column) -> Column:
    """Array with the first day of every month from ``first`` to ``last``."""
    return F.sequence(month_start(first), month_start(last), F.expr("interval 1 month"))


def month_cycle(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month of the year."""
    angle = (F.month(date) - 1) * F.lit(2.0) * F.pi() / F.lit(12.0)
    return F.sin(angle), F.cos(angle)
