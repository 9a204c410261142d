"""Change between a recent period and the one before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.features.panel import PRODUCTS, Aggregates
from ebbtide.functions.safe import RATIO_EPS, ratio, shifted_ratio

PERIODS = (("1m", "1", "p1"), ("3m", "3", "p3"), ("6m", "6", "p6"))


def change(a: Aggregates) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for label, now, before in PERIODS:
        sides = {
            "txn_count": (a.rows(now), a.rows(before)),
            "amt": (a.sum("total_amt", now), a.sum("total_amt", before)),
            "products": (a.mean(PRODUCTS, now), a.mean(PRODUCTS, before)),
        }
        for what, (r, p) in sides.items():
            pct = shifted_ratio(r - p, p) * F.lit(100)
            values = {
                "recent": r,
                "previous": p,
                "change_pct": pct,
                "change_ratio": ratio(r, p + F.lit(RATIO_EPS)),
            }
            for kind, v in values.items():
                out[f"behavior_{what}_{kind}_{label}"] = v
                if label == "3m" and kind != "change_ratio":
                    out[f"behavior_{what}_{kind}"] = v
    out["behavior_txn_recent_share_1m_over_6m"] = ratio(a.rows("1"), a.rows("6") / F.lit(6.0))
    out["behavior_amt_recent_share_1m_over_6m"] = ratio(
        a.sum("total_amt", "1"), a.sum("total_amt", "6") / F.lit(6.0)
    )
    txn, amt = out["behavior_txn_count_change_pct_3m"], out["behavior_amt_change_pct_3m"]
    month = out["behavior_txn_count_change_pct_1m"]
    known = a.rows("12").isNotNull()
    out["behavior_activity_trend"] = F.when(
        known,
        F.when(txn.isNull() | amt.isNull(), F.lit(0))
        .when((txn < -20) | (amt < -20) | F.coalesce(month < -30, F.lit(False)), F.lit(-1))
        .when((txn > 20) | (amt > 20), F.lit(1))
        .otherwise(F.lit(0)),
    )
    parts = [
        F.coalesce(F.abs(out[f"behavior_{what}_change_pct_{label}"]), F.lit(0.0))
        for label, _, _ in PERIODS
        for what in ("txn_count", "amt")
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out["behavior_volatility_score"] = F.when(known, total / F.lit(6.0))
    return out
