"""Inactivity, gaps and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.lifecycle import peak_month
from ebbtide.features.panel import Aggregates
from ebbtide.functions import periods
from ebbtide.functions.safe import RATIO_EPS, ratio, shifted_ratio


def mean_gap(a: Aggregates, tag: str) -> Column:
    """Mean days between neighbouring rows: the gaps telescope to last minus first."""
    if tag == "all":
        first, last, n = a.latest("run_first"), a.latest("date"), a.latest("row_no")
    else:
        first, last, n = a.min("date", tag), a.max("date", tag), a.rows(tag)
    return F.when(n > 1, ratio(F.datediff(last, first), n - 1))


def timing(a: Aggregates) -> dict[str, Column]:
    """Needs ``tenure`` from the customer table."""
    ref = F.col("ref_date")
    last, last12 = a.latest("date"), a.max("date", "12")
    quiet = periods.month_number(ref) - periods.month_number(last12)
    out = {
        "time_days_since_account_open": F.col("tenure") * 30,
        "time_days_since_first_txn": F.datediff(ref, a.latest("run_first")),
        "time_days_since_last_txn": F.datediff(ref, last),
        "time_inactive_months_last_12m": F.when(
            last12.isNotNull(), F.greatest(F.lit(12) - a.active_months("12"), F.lit(0))
        ),
        "time_consecutive_inactive_months": F.when(
            last12.isNotNull(), F.least(F.greatest(quiet, F.lit(0)), F.lit(12))
        ),
    }
    for w in (1, 3, 6):
        t = str(w)
        n, months = a.rows(t), a.active_months(t)
        out[f"time_txn_count_last_{w}m"] = n
        out[f"time_txn_per_month_last_{w}m"] = n / F.lit(float(w))
        out[f"time_active_months_last_{w}m"] = months
        out[f"time_inactive_months_last_{w}m"] = F.when(
            months.isNotNull(), F.greatest(F.lit(w) - months, F.lit(0))
        )
        out[f"time_activity_share_last_{w}m"] = ratio(n, a.rows("12") / F.lit(12.0) + F.lit(RATIO_EPS))
        out[f"time_avg_days_between_txn_last_{w}m"] = mean_gap(a, t)
    out["time_activity_decay_rate"] = shifted_ratio(a.rows("old") - a.rows("3"), a.rows("old"))
    out["time_activity_acceleration_1m_vs_3m"] = (
        ratio(a.rows("1"), a.rows("3") / F.lit(3.0) + F.lit(RATIO_EPS)) - 1
    )
    out["time_days_since_peak_activity"] = F.datediff(ref, peak_month(a))
    out["time_avg_days_between_txn"] = mean_gap(a, "all")
    out["time_days_between_last_two_txn"] = F.datediff(last, a.latest("prev_date"))
    return out
