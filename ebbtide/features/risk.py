"""Churn-risk signals (opt-in family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.features.panel import CC_AMT, EFT_AMT, KEYS, PRODUCTS, Aggregates, placed
from ebbtide.functions import periods
from ebbtide.functions.safe import clip, ratio, shifted_ratio

# Fixed values.
SEVERE_PCT = -50
RFM_HORIZON_DAYS = 180
RFM_PARTS = (0.3, 0.4, 0.3)


def risk(a: Aggregates) -> dict[str, Column]:
    """The row-additive signals; helper columns ``_risk_*`` feed the cohort-relative ones."""
    ref = F.col("ref_date")
    now, before = a.sum("total_amt", "3"), a.sum("total_amt", "p3")
    n, p = a.rows("3"), a.rows("p3")
    pct = shifted_ratio(now - before, before) * F.lit(100)
    size_now, size_before = shifted_ratio(now, n), shifted_ratio(before, p)
    last12 = a.max("date", "12")
    # A product value is abandoned when its latest row up to the reference date lies in months 7 to 12.
    latest = F.col("next_same").isNull() | (F.col("next_same") > ref)
    gone = a.add(
        "_abandoned", lambda: F.count_if(Aggregates.within("p6") & latest & F.col(PRODUCTS).isNotNull())
    )
    return {
        "churn_spending_decline_3m_vs_6m": pct,
        "churn_severe_decline_flag": F.when(
            n.isNotNull() | p.isNotNull(), F.coalesce(pct < SEVERE_PCT, F.lit(False)).cast("int")
        ),
        "churn_consecutive_months_no_activity": periods.month_number(ref) - periods.month_number(last12),
        "churn_product_abandonment_count": F.when(a.latest("row_no").isNotNull(), gone),
        "churn_txn_frequency_drop_pct": shifted_ratio(n - p, p) * F.lit(100),
        "churn_avg_txn_size_drop_pct": shifted_ratio(size_now - size_before, size_before) * F.lit(100),
        "churn_balance_decline_velocity": calendar_slope(a),
        "churn_channel_diversity_drop": channels(a, "p3") - channels(a, "3"),
        "_risk_rec_now": F.datediff(ref, a.max("date", "3")),
        "_risk_rec_before": F.datediff(periods.back(ref, 3), a.max("date", "p3")),
        "_risk_n_now": n,
        "_risk_n_before": p,
        "_risk_amt_now": now,
        "_risk_amt_before": before,
        "_risk_recency": F.datediff(ref, a.latest("date")),
    }


def channels(a: Aggregates, tag: str) -> Column:
    """How many of the two channels moved money in the window; null for an empty window."""
    used = [
        a.add(
            f"_chan_{c}_{tag}",
            lambda c=c: F.max(F.when(Aggregates.within(tag), F.coalesce(F.col(c) > 0, F.lit(False)).cast("int"))),
        )
        for c in (EFT_AMT, CC_AMT)
    ]
    return used[0] + used[1]


def calendar_slope(a: Aggregates) -> Column:
    """Slope of monthly sums on the calendar month over a year; 0 for fewer than two months."""
    a.active_months("12")
    bits = F.col("_months_12")
    x = F.lit(12) - F.col("month_gap")
    inside = Aggregates.within("12")
    sxy = a.add("_cal_xy", lambda: F.sum(F.when(inside, x * F.col("total_amt"))))
    sy = a.add("_cal_y", lambda: F.sum(F.when(inside, F.col("total_amt"))))
    sx, sxx = F.lit(0.0), F.lit(0.0)
    for gap in range(13):
        has = (bits.bitwiseAND(F.lit(1 << gap)) != 0).cast("double")
        sx = sx + has * F.lit(12.0 - gap)
        sxx = sxx + has * F.lit((12.0 - gap) ** 2)
    months = F.bit_count(bits).cast("double")
    slope = ratio(months * sxy - sx * sy, months * sxx - sx * sx)
    return F.when(bits.isNull(), F.lit(None)).when(months < 2, F.lit(0.0)).otherwise(slope)


def rfm_level(rec: Column, n: Column, amt: Column, n95: Column, amt95: Column) -> Column:
    """Recency, frequency and money on one scale; the 95th percentile of the cohort counts as full."""
    r, f, m = RFM_PARTS
    share = F.when((amt95 == 0) & (amt > 0), F.lit(1.0)).otherwise(clip(ratio(amt, amt95), 0.0, 1.0))
    return (
        F.lit(r) * (F.lit(1) - rec / F.lit(float(RFM_HORIZON_DAYS)))
        + F.lit(f) * clip(ratio(n, n95), 0.0, 1.0)
        + F.lit(m) * share
    )


def peak_quarter(history: DataFrame, cohort: DataFrame, month_places: DataFrame, tasks: int | None = None) -> DataFrame:
    """Largest sum of rows over three neighbouring observed cohort months, per (cust_id, ref_date).

    A best window can always be moved left until it ends in a month the customer was active in, so only those
    months are looked at and no customer-by-month grid is built. ``month_places`` numbers the months seen in
    the cohort: (ref_date, month_no, place).
    """
    days = placed(history.select("cust_id", "date").distinct(), tasks)
    rows = placed(cohort.select(*KEYS).distinct(), tasks).join(days, "cust_id").where(F.col("date") <= F.col("ref_date"))
    months = rows.groupBy(*KEYS, periods.month_number(F.col("date")).alias("month_no")).agg(F.count(F.lit(1)).alias("c"))
    numbered = months.join(month_places, ["ref_date", "month_no"])
    near = Window.partitionBy(*KEYS).orderBy("place").rangeBetween(-2, Window.currentRow)
    return numbered.withColumn("c3", F.sum("c").over(near)).groupBy(*KEYS).agg(F.max("c3").alias("_peak_quarter"))
