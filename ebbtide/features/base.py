"""Base families: windows, trend, recency, behavioural patterns, season."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.panel import CC_AMT, CC_CNT, DIFFED, EFT_AMT, EFT_CNT, MEASURES, PRODUCTS, Aggregates
from ebbtide.functions import periods
from ebbtide.functions.safe import shifted_ratio

# Fixed values.
WINDOWS = (1, 3, 6, 12)
EPS = 1e-6
ALIASES = {CC_AMT: "cc_amt", CC_CNT: "cc_cnt", EFT_AMT: "eft_amt", EFT_CNT: "eft_cnt"}


def windows(a: Aggregates) -> dict[str, Column]:
    """Sum, mean, deviation and extremes of the five measures in each window, and the row count."""
    out: dict[str, Column] = {}
    for w in WINDOWS:
        t = str(w)
        for c in MEASURES:
            if c != PRODUCTS:
                out[f"{c}_sum_{w}m"] = a.sum(c, t)
            out[f"{c}_mean_{w}m"] = a.mean(c, t)
            out[f"{c}_std_{w}m"] = a.std(c, t)
            if c == PRODUCTS:
                out[f"{c}_min_{w}m"] = a.min(c, t)
            out[f"{c}_max_{w}m"] = a.max(c, t)
        out[f"active_months_{w}m"] = a.rows(t)
    return out


def trend(a: Aggregates) -> dict[str, Column]:
    """Row-to-row differences inside the last six periods; the first row of the window has none."""
    out: dict[str, Column] = {}
    inside = a.within("6") & (F.col("prev_date") > F.col("start6"))
    for c in DIFFED:
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{c}_trend_{stat}"] = a.add(
                f"_diff_{stat}_{c}", lambda fn=fn, c=c: fn(F.when(inside, F.col(f"diff_{c}")))
            )
    return out


def recency(a: Aggregates) -> dict[str, Column]:
    ref = F.col("ref_date")
    return {
        "days_since_last_activity": F.datediff(ref, a.latest("date")),
        "days_since_first_activity_rel": F.datediff(ref, a.latest("run_first")),
        "days_since_last_eft": F.datediff(ref, a.latest("run_eft")),
        "days_since_last_cc": F.datediff(ref, a.latest("run_cc")),
    }


def patterns(a: Aggregates) -> dict[str, Column]:
    """Variation, channel ratios, sizes and product engagement over twelve periods."""
    first = a.add("_first_products", lambda: F.min_by(PRODUCTS, F.when(a.within("12"), F.col("date"))))
    last = a.add("_last_products", lambda: F.max_by(PRODUCTS, F.when(a.within("12"), F.col("date"))))
    n = a.rows("12")
    out = {f"{c}_cv": shifted_ratio(a.std(c, "12"), a.mean(c, "12")) for c in (EFT_CNT, CC_CNT)}
    out["eft_to_cc_cnt_ratio"] = shifted_ratio(a.sum(EFT_CNT, "12"), a.sum(CC_CNT, "12"))
    out["eft_to_cc_amt_ratio"] = shifted_ratio(a.sum(EFT_AMT, "12"), a.sum(CC_AMT, "12"))
    out["avg_eft_size"] = shifted_ratio(a.sum(EFT_AMT, "12"), a.sum(EFT_CNT, "12"))
    out["avg_cc_size"] = shifted_ratio(a.sum(CC_AMT, "12"), a.sum(CC_CNT, "12"))
    out["avg_active_products"] = a.mean(PRODUCTS, "12")
    out["max_active_products"] = a.max(PRODUCTS, "12")
    out["product_decline"] = F.when(n > 1, first - last).when(n == 1, F.lit(0.0))
    return out


def decile_signals(a: Aggregates) -> dict[str, Column]:
    """Collapse, volatility, personal z, recency-weighted level and burstiness per measure; channel mix."""
    out: dict[str, Column] = {}
    in_year = a.rows("12").isNotNull()
    quiet = F.datediff(F.col("ref_date"), a.latest("date")) / F.lit(30.0)
    for c, alias in ALIASES.items():
        m1, m3, m6, m12 = (a.mean(c, t) for t in ("1", "3", "6", "12"))
        s3, s6, s12 = (a.std(c, t) for t in ("3", "6", "12"))
        collapse = shifted_ratio(m3 - m12, m12, EPS)
        spike = shifted_ratio(s3 - s12, s12, EPS)
        fano = shifted_ratio(F.pow(s6, F.lit(2.0)), m6, EPS)
        out[f"{alias}_collapse_3v12"] = collapse
        out[f"{alias}_index_3m_12m"] = collapse
        out[f"{alias}_vol_spike_3v12"] = spike
        out[f"{alias}_vol_spike_6m"] = spike
        out[f"{alias}_personal_z"] = shifted_ratio(m1 - m12, s12)
        out[f"{alias}_recency_intensity"] = F.when(in_year, F.exp(F.lit(-0.2) * quiet) * m3)
        out[f"{alias}_burstiness_6m"] = fano
        out[f"{alias}_burst_fano_6m"] = fano
    amt = shifted_ratio(a.mean(CC_AMT, "3"), a.mean(CC_AMT, "3") + a.mean(EFT_AMT, "3"), EPS)
    cnt = shifted_ratio(a.mean(CC_CNT, "3"), a.mean(CC_CNT, "3") + a.mean(EFT_CNT, "3"), EPS)
    out["mix_amt_cc_3m"] = amt
    out["mix_cnt_cc_3m"] = cnt
    out["mix_cc_eft_amt_3m"] = amt
    out["mix_cc_eft_cnt_3m"] = cnt
    out["mix_cc_eft_3m"] = amt
    return out


def season(a: Aggregates) -> dict[str, Column]:
    sin, cos = periods.month_cycle(F.col("ref_date"))
    return {"month_sin": sin, "month_cos": cos}
