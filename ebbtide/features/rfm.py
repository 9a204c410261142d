"""Recency, frequency, monetary: values, quantile scores, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.panel import Aggregates
from ebbtide.functions.safe import ratio, shifted_ratio

# Weights, decay, and the segments in match order as (R, F, M) inclusive ranges with their rank.
WEIGHTS = {"r": 0.15, "f": 0.45, "m": 0.40}
DECAY_DAYS = 45.0
SEGMENTS = {
    "Champions": ((4, 5), (4, 5), (4, 5), 11),
    "Loyal Customers": ((2, 5), (3, 5), (3, 5), 10),
    "Potential Loyalist": ((3, 5), (1, 3), (1, 3), 9),
    "Recent Customers": ((4, 5), (0, 1), (0, 1), 8),
    "Promising": ((3, 4), (0, 1), (0, 1), 7),
    "Needs Attention": ((2, 3), (2, 3), (2, 3), 6),
    "About to Sleep": ((2, 3), (0, 2), (0, 2), 5),
    "At Risk": ((0, 2), (2, 5), (2, 5), 4),
    "Cannot Lose Them": ((0, 1), (4, 5), (4, 5), 3),
    "Hibernating": ((1, 2), (1, 2), (1, 2), 2),
    "Lost": ((0, 2), (0, 2), (0, 2), 1),
}
SCORED = {"r": "rfm_recency_days", "f": "rfm_frequency_count", "m": "rfm_monetary_value"}
QUINTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def values(a: Aggregates) -> dict[str, Column]:
    n12, m12 = a.rows("12"), a.sum("total_amt", "12")
    days = F.datediff(F.col("ref_date"), F.col("date"))
    out = {
        "rfm_recency_days": F.datediff(F.col("ref_date"), a.max("date", "12")),
        "rfm_frequency_count": n12,
        "rfm_monetary_value": m12,
        "rfm_avg_transaction_value": shifted_ratio(m12, n12),
        "rfm_frequency_per_day": n12 / F.lit(365.0),
    }
    for w in (3, 6):
        n, m = a.rows(str(w)), a.sum("total_amt", str(w))
        out[f"rfm_frequency_count_{w}m"] = n
        out[f"rfm_monetary_value_{w}m"] = m
        out[f"rfm_frequency_per_month_{w}m"] = n / F.lit(float(w))
        out[f"rfm_avg_transaction_value_{w}m"] = shifted_ratio(m, n)
        out[f"rfm_frequency_share_{w}m"] = ratio(n, n12)
        out[f"rfm_frequency_delta_{w}m"] = n - n12 * F.lit(w / 12.0)
        out[f"rfm_monetary_share_{w}m"] = ratio(m, m12)
        out[f"rfm_monetary_delta_{w}m"] = m - m12 * F.lit(w / 12.0)
    out["rfm_recency_exp_weighted"] = a.add(
        "_recency_exp", lambda: F.sum(F.when(a.within("12"), F.exp(-days / F.lit(DECAY_DAYS))))
    )
    return out


def inner_edges(edges: Column) -> tuple[Column, Column]:
    """Inner bin edges and number of bins of an array of quantiles. Repeated edges collapse."""
    distinct = F.array_distinct(edges)
    bins = F.size(distinct) - 1
    return F.slice(distinct, F.lit(2), F.greatest(bins - 1, F.lit(0))), bins


def bin_code(x: Column, inner: Column, bins: Column) -> Column:
    """Zero-based right-closed bin of ``x``; null when all edges collapsed into one."""
    code = F.size(F.filter(inner, lambda e: e < x.cast("double")))
    return F.when(x.isNotNull() & (bins > 0), code)


def score(x: Column, inner: Column, bins: Column, reverse: bool = False) -> Column:
    code = bin_code(x, inner, bins)
    return (bins - code if reverse else code + 1).cast("double")


def composite(r: Column, f: Column, m: Column) -> Column:
    one = F.lit(1.0)
    parts = [F.lit(WEIGHTS[k]) * F.coalesce(v, one) for k, v in (("r", r), ("f", f), ("m", m))]
    return parts[0] + parts[1] + parts[2]


def segment(r: Column, f: Column, m: Column) -> Column:
    """First segment whose three ranges hold; ``Lost`` when none does or a score is missing."""
    out = F.when(r.isNull() | f.isNull() | m.isNull(), F.lit("Lost"))
    for name, (rr, fr, mr, _) in SEGMENTS.items():
        out = out.when(r.between(*rr) & f.between(*fr) & m.between(*mr), F.lit(name))
    return out.otherwise(F.lit("Lost"))


def segment_rank(seg: Column) -> Column:
    out = None
    for name, spec in SEGMENTS.items():
        out = F.when(seg == name, F.lit(spec[3])) if out is None else out.when(seg == name, F.lit(spec[3]))
    return out
