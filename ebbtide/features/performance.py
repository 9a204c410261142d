"""Eight lean features with plain defaults instead of a sentinel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.panel import PRODUCTS, Aggregates
from ebbtide.functions import periods
from ebbtide.functions.safe import ratio, right_closed_bin

# Fixed values.
BRACKET_EDGES = (0, 90, 180, 365, 730, 10000)
BRACKET_LABELS = ("0-3m", "3-6m", "6-12m", "1-2y", "2y+")
PEER_MIN = 10
PEER_SHARE = 0.5
NEW_JOINER_DAYS = 180


def performance(a: Aggregates) -> dict[str, Column]:
    """The six that need only the customer's rows; the helper columns ``_perf_*`` feed the two cohort ones."""
    ref = F.col("ref_date")

    def sum_left(band: int) -> Column:
        return a.add(
            f"_left_sum_{band}", lambda: F.sum(F.when(F.col("left_band") == band, F.col("total_cnt")))
        )

    def distinct_left(band: int) -> Column:
        # A value counts at its latest row up to the reference date.
        latest = F.col("next_same").isNull() | (F.col("next_same") > ref)
        here = (F.col("left_band") <= band) & latest & F.col(PRODUCTS).isNotNull()
        return a.add(f"_left_distinct_{band}", lambda: F.count_if(here))

    first, last = a.latest("run_first"), a.latest("date")
    quiet = periods.month_number(ref) - periods.month_number(last)
    tenure_days = F.coalesce(F.datediff(ref, first), F.lit(0))
    return {
        "activity_drop_ratio": F.coalesce(sum_left(3), F.lit(0.0))
        / F.greatest(F.coalesce(sum_left(6), F.lit(0.0)), F.lit(1.0)),
        "days_since_last_txn": F.coalesce(F.datediff(ref, last), F.lit(0)),
        "balance_trend": ordinal_slope(a),
        "product_abandonment": F.lit(1) - distinct_left(3) / F.greatest(distinct_left(6), F.lit(1)),
        "txn_irregularity": F.coalesce(
            ratio(a.latest("run_cnt_std"), a.latest("run_cnt_mean") + F.lit(1e-9)), F.lit(0.0)
        ),
        "consecutive_inactive_months": F.coalesce(F.least(quiet, F.lit(6)), F.lit(6)),
        "_perf_tenure_days": tenure_days,
        "_perf_cnt": a.latest("run_cnt"),
        "_perf_amt": F.coalesce(a.latest("run_amt"), F.lit(0.0)),
        "_perf_bracket": right_closed_bin(tenure_days, BRACKET_EDGES, BRACKET_LABELS),
    }


def ordinal_slope(a: Aggregates) -> Column:
    """Least-squares slope of monthly sums on the month's place 0..n-1; 0 for fewer than three months.

    Sums over rows are enough: x of a row is the place of its month among the customer's months.
    """
    months = (a.latest("month_ord") + 1).cast("double")
    sxy, sy = a.latest("run_xy"), a.latest("run_amt")
    sx = months * (months - 1) / 2
    sxx = (months - 1) * months * (2 * months - 1) / 6
    slope = ratio(months * sxy - sx * sy, months * sxx - sx * sx)
    return F.when(months >= 3, slope).otherwise(F.lit(0.0))
