"""Tenure, engagement, consistency and stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.panel import PEAK_BASE, PRODUCTS, Aggregates, month_from_number
from ebbtide.functions.safe import shifted_ratio


def lifecycle(a: Aggregates) -> dict[str, Column]:
    """Needs ``tenure`` (months) from the customer table and ``cohort_months`` (months seen in the cohort)."""
    ref, tenure = F.col("ref_date"), F.col("tenure")
    n = a.latest("row_no")
    rate = shifted_ratio(n, tenure)
    out = {
        "lifecycle_tenure_days": tenure * 30,
        "lifecycle_days_since_first_txn": F.datediff(ref, a.latest("run_first")),
        "lifecycle_txn_per_month": rate,
        "lifecycle_products_per_year": a.mean(PRODUCTS, "12"),
    }
    for w in (3, 6):
        m = a.rows(str(w))
        out[f"lifecycle_txn_per_month_{w}m"] = m / F.lit(float(w))
        out[f"lifecycle_txn_share_{w}m"] = shifted_ratio(m, n)
        out[f"lifecycle_products_avg_{w}m"] = a.mean(PRODUCTS, str(w))
    out["lifecycle_activity_consistency"] = consistency(a)
    out["lifecycle_days_since_peak"] = F.datediff(ref, peak_month_6(a))
    out["lifecycle_txn_trend_6m"] = shifted_ratio(a.rows("6") - a.rows("p6"), a.rows("p6"))
    now, before = a.sum("total_amt", "6"), a.sum("total_amt", "p6")
    out["lifecycle_amt_trend_6m"] = shifted_ratio(now - before, before)
    days = tenure * 30
    out["lifecycle_stage"] = (
        F.when(days.isNull() | rate.isNull(), F.lit(0))
        .when(days < 180, F.when(rate > 2, F.lit(1)).otherwise(F.lit(2)))
        .when(days < 730, F.when(rate > 3, F.lit(3)).otherwise(F.lit(4)))
        .otherwise(F.when(rate > 2, F.lit(5)).otherwise(F.lit(6)))
    )
    return out


def consistency(a: Aggregates) -> Column:
    """1 / (std / (mean + 1) + 1) of monthly row counts, months without rows counting as zero.

    The sum of squared month counts is a sum over rows: the i-th row of a month adds 2i - 1.
    """
    squares = a.latest("run_squares")
    total, months = a.latest("row_no"), F.col("cohort_months")
    mean = total / months
    var = (squares - months * mean * mean) / F.nullif(months - 1, F.lit(0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.when(var.isNotNull(), F.lit(1.0) / (shifted_ratio(std, mean) + 1))


def _peak_code(cond: Column) -> Column:
    return F.max(F.when(cond, F.col("peak_code")))


def peak_month(a: Aggregates) -> Column:
    """First day of the month with most rows."""
    code = a.latest("run_peak")
    return month_from_number(F.lit(PEAK_BASE) - code % PEAK_BASE)


def peak_month_6(a: Aggregates) -> Column:
    """The same inside the last six periods. The month the window starts in counts only its part inside."""
    start_month = F.year("start6") * 12 + F.month("start6")
    inside = Aggregates.within("6")
    code = a.add("_peak_6", lambda: _peak_code(inside & (F.col("month_no") > start_month)))
    partial = a.add("_peak_6_start", lambda: F.count_if(inside & (F.col("month_no") == start_month)))
    start_no = a.add("_start_month", lambda: F.max(start_month))
    others = F.coalesce(F.floor(code / PEAK_BASE), F.lit(0))
    later = F.lit(PEAK_BASE) - code % PEAK_BASE
    no = F.when((partial > 0) & (partial >= others), start_no).otherwise(later)
    return month_from_number(no)
