"""Feature families (A1, B, C, D, E rows of the survey) against plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import (
    BASE, CUSTOMERS_SQL, HISTORY_SQL, PANEL, PIT, cohort, customers, history, query, within,
)
from ebbtide.features import base, rfm
from ebbtide.features.build import (
    attach_labels, cohort_months, feature_table, model_matrix,
)
from ebbtide.features.demographics import demographics
from ebbtide.features.panel import CC_AMT, CC_CNT, EFT_AMT, EFT_CNT, KEYS, MEASURES, PRODUCTS, merge_same_day
from ebbtide.sources import adapters

G = "GROUP BY cust_id, ref_date"


def table(spark, path, families, dates=adapters.REF_DATES, **kw) -> DataFrame:
    kw = {"winsorize": False, "relative": False, "sentinel": False, "with_demographics": False, **kw}
    return feature_table(history(spark, path), customers(spark, path), cohort(spark, path, dates), families, **kw)


def rounded(df: DataFrame, columns=None, digits: int = 6, coarse=()) -> DataFrame:
    """Keys and the chosen columns as rounded doubles (``+ 0.0`` removes a negative zero)."""
    columns = columns or [c for c in df.columns if c not in (*KEYS, "rfm_segment")]
    return df.select(
        *[c for c in KEYS if c in df.columns],
        *[
            F.col(c) if t == "string" else
            (F.round(F.col(c).cast("double"), 3 if c in coarse else digits) + F.lit(0.0)).alias(c)
            for c, t in df.select(*columns).dtypes
        ],
    )


def sql_rounded(inner: str, cols: dict[str, str], digits: int = 6, coarse=(), keys: str = "cust_id, ref_date") -> str:
    """``inner`` is CTEs; ``cols`` maps a name to (sql expression); the FROM part is in ``cols['__from']``."""
    tail = cols["__from"]
    body = ", ".join(f"{e} AS {n}" for n, e in cols.items() if n != "__from")
    outer = ", ".join(
        f"round(CAST({n} AS DOUBLE), {3 if n in coarse else digits}) + 0.0 AS {n}" for n in cols if n != "__from"
    )
    return f"{inner} SELECT {keys}, {outer} FROM (SELECT {keys}, {body} {tail})"


def family(name: str, families, cols: dict[str, str], ctes: str = PIT, tail: str = f"FROM j {G}", coarse=(), **kw):
    """Register: the named columns of the families equal the SQL expressions grouped over the joined rows."""
    sql = sql_rounded(ctes, {**cols, "__from": tail}, coarse=coarse)
    query(name, sql)(lambda spark, path: rounded(table(spark, path, families, **kw), list(cols), coarse=coarse))


def n(w: str) -> str:
    return f"nullif(count(*) FILTER (WHERE {w}), 0)"


def agg(fn: str, c: str, w: str) -> str:
    return f"{fn}({c}) FILTER (WHERE {w})"


W1, W3, W6, W12 = (within(m) for m in (1, 3, 6, 12))
P1, P3, P6, OLD = within(2, 1), within(6, 3), within(12, 6), within(9, 6)
WS = {1: W1, 3: W3, 6: W6, 12: W12}

# ---------------------------------------------------------------- sources, cohort, joins

query("a1_history", f"{PANEL} SELECT cust_id, date, {', '.join(MEASURES)} FROM h")(
    lambda s, p: merge_same_day(history(s, p))
)
query("a1_customers", f"WITH {CUSTOMERS_SQL.strip()} SELECT * FROM customers")(lambda s, p: customers(s, p))
query("a1_cohort", f"{BASE} SELECT * FROM cohort")(lambda s, p: cohort(s, p))
query("c1_cohort_history", f"{BASE} SELECT cust_id, date, total FROM (SELECT h.cust_id, h.date, "
      "h.mobile_eft_all_amt + h.cc_transaction_all_amt AS total FROM h WHERE cust_id IN (SELECT cust_id FROM cohort))")(
    lambda s, p: history(s, p).join(cohort(s, p).select("cust_id").distinct(), "cust_id", "left_semi")
    .select("cust_id", "date", (F.col(EFT_AMT) + F.col(CC_AMT)).alias("total"))
)
query("f3_distinct_dates", f"{BASE} SELECT DISTINCT ref_date FROM cohort")(
    lambda s, p: cohort(s, p).select("ref_date").distinct()
)


@query("c2_point_in_time", f"{PIT} SELECT cust_id, ref_date, count(*) AS n_rows, min(date) AS first_date, "
       f"max(date) AS last_date, sum(total_amt) AS total_amt FROM j {G}")
def c2_point_in_time(spark, path):
    from ebbtide.features.panel import point_in_time

    return (
        point_in_time(history(spark, path), cohort(spark, path), horizon=None).where("date is not null").groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
             F.sum("total_amt").alias("total_amt"))
    )


# ---------------------------------------------------------------- base families

STD_COLS = [f"{c}_std_{w}m" for c in MEASURES for w in WS]
cols = {}
for w, cond in WS.items():
    for c in MEASURES:
        stats = ("avg", "stddev_samp", "min", "max") if c == PRODUCTS else ("sum", "avg", "stddev_samp", "max")
        for fn in stats:
            label = {"avg": "mean", "stddev_samp": "std"}.get(fn, fn)
            cols[f"{c}_{label}_{w}m"] = agg(fn, c, cond)
    cols[f"active_months_{w}m"] = n(cond)
family("d1_multi_window", ["windows"], cols, coarse=STD_COLS)

trend_cols = {}
for c in (EFT_AMT, CC_AMT, PRODUCTS):
    for fn, label in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")):
        trend_cols[f"{c}_trend_{label}"] = f"{fn}(d_{c})"
DIFFS = ", ".join(
    f"{c} - lag({c}) OVER (PARTITION BY cust_id, ref_date ORDER BY date) AS d_{c}" for c in (EFT_AMT, CC_AMT, PRODUCTS)
)
family(
    "e1_period_difference", ["trend"],
    {k: f"max({k})" for k in trend_cols},
    ctes=f"{PIT}, d AS (SELECT cust_id, ref_date, {DIFFS} FROM j WHERE {W6}), "
    f"t AS (SELECT cust_id, ref_date, {', '.join(f'{v} AS {k}' for k, v in trend_cols.items())} FROM d {G} "
    f"UNION ALL SELECT DISTINCT cust_id, ref_date, {', '.join('NULL' for _ in trend_cols)} FROM j)",
    tail=f"FROM t {G}", coarse=[f"{c}_trend_std" for c in (EFT_AMT, CC_AMT)],
)

family("d2_recency", ["recency"], {
    "days_since_last_activity": "date_diff('day', max(date), ref_date)",
    "days_since_first_activity_rel": "date_diff('day', min(date), ref_date)",
    "days_since_last_eft": f"date_diff('day', max(date) FILTER (WHERE {EFT_CNT} > 0), ref_date)",
    "days_since_last_cc": f"date_diff('day', max(date) FILTER (WHERE {CC_CNT} > 0), ref_date)",
})
query("b5_active_rows", f"{PIT} SELECT cust_id, ref_date, max(date) FILTER (WHERE {EFT_CNT} > 0) AS last_eft, "
      f"max(date) FILTER (WHERE {CC_CNT} > 0) AS last_cc FROM j {G}")(
    lambda s, p: table(s, p, ["recency"]).select(
        *KEYS, F.date_sub("ref_date", "days_since_last_eft").alias("last_eft"),
        F.date_sub("ref_date", "days_since_last_cc").alias("last_cc"))
)
family("d3_variation", ["patterns"], {
    f"{c}_cv": f"{agg('stddev_samp', c, W12)} / ({agg('avg', c, W12)} + 1)" for c in (EFT_CNT, CC_CNT)
})


def s12(c):
    return agg("sum", c, W12)


family("d4_ratios", ["patterns"], {
    "eft_to_cc_cnt_ratio": f"{s12(EFT_CNT)} / ({s12(CC_CNT)} + 1)",
    "eft_to_cc_amt_ratio": f"{s12(EFT_AMT)} / ({s12(CC_AMT)} + 1)",
    "avg_eft_size": f"{s12(EFT_AMT)} / ({s12(EFT_CNT)} + 1)",
    "avg_cc_size": f"{s12(CC_AMT)} / ({s12(CC_CNT)} + 1)",
})
family("d5_engagement", ["patterns"], {
    "avg_active_products": agg("avg", PRODUCTS, W12),
    "max_active_products": agg("max", PRODUCTS, W12),
    "product_decline": f"CASE WHEN {n(W12)} > 1 THEN arg_min({PRODUCTS}, date) FILTER (WHERE {W12}) - "
    f"arg_max({PRODUCTS}, date) FILTER (WHERE {W12}) WHEN {n(W12)} = 1 THEN 0 END",
})
decile, EPS = {}, "0.000001"
for c, alias in base.ALIASES.items():
    m = {w: agg("avg", c, WS[w]) for w in WS}
    sd = {w: agg("stddev_samp", c, WS[w]) for w in WS}
    for name in ("collapse_3v12", "index_3m_12m"):
        decile[f"{alias}_{name}"] = f"({m[3]} - {m[12]}) / ({m[12]} + {EPS})"
    for name in ("vol_spike_3v12", "vol_spike_6m"):
        # A deviation of exactly zero leaves only the small constant in the denominator.
        decile[f"{alias}_{name}"] = f"({sd[3]} - {sd[12]}) / ({sd[12]} + {EPS})"
    decile[f"{alias}_personal_z"] = f"({m[1]} - {m[12]}) / (1.0 + {sd[12]})"
    decile[f"{alias}_recency_intensity"] = (
        f"exp(-0.2 * (date_diff('day', max(date), ref_date) / 30.0)) * {m[3]}"
    )
    for name in ("burstiness_6m", "burst_fano_6m"):
        decile[f"{alias}_{name}"] = f"pow({sd[6]}, 2) / ({m[6]} + {EPS})"
family("d6_decile_signals", ["deciles"], decile,
       coarse=[k for k in decile if "intensity" in k or "burst" in k])
m3 = {c: agg("avg", c, W3) for c in MEASURES}
amt = f"{m3[CC_AMT]} / ({m3[CC_AMT]} + {m3[EFT_AMT]} + {EPS})"
cnt = f"{m3[CC_CNT]} / ({m3[CC_CNT]} + {m3[EFT_CNT]} + {EPS})"
family("d7_channel_mix", ["deciles"], {
    "mix_amt_cc_3m": amt, "mix_cnt_cc_3m": cnt, "mix_cc_eft_amt_3m": amt, "mix_cc_eft_cnt_3m": cnt, "mix_cc_eft_3m": amt,
})
family("g5_month_cycle", ["season"], {
    "month_sin": "sin(2 * pi() * (month(ref_date) - 1) / 12.0)",
    "month_cos": "cos(2 * pi() * (month(ref_date) - 1) / 12.0)",
})

# ---------------------------------------------------------------- RFM

family("d8_rfm_base", ["rfm"], {
    "rfm_recency_days": f"date_diff('day', max(date) FILTER (WHERE {W12}), ref_date)",
    "rfm_frequency_count": n(W12),
    "rfm_monetary_value": agg("sum", "total_amt", W12),
})
short = {
    "rfm_avg_transaction_value": f"{agg('sum', 'total_amt', W12)} / ({n(W12)} + 1)",
    "rfm_frequency_per_day": f"{n(W12)} / 365.0",
}
for w in (3, 6):
    nn, mm = n(WS[w]), agg("sum", "total_amt", WS[w])
    short |= {
        f"rfm_frequency_count_{w}m": nn,
        f"rfm_monetary_value_{w}m": mm,
        f"rfm_frequency_per_month_{w}m": f"{nn} / {w}.0",
        f"rfm_avg_transaction_value_{w}m": f"{mm} / ({nn} + 1)",
        f"rfm_frequency_share_{w}m": f"{nn} / CAST({n(W12)} AS DOUBLE)",
        f"rfm_frequency_delta_{w}m": f"{nn} - {n(W12)} * ({w} / 12.0)",
        f"rfm_monetary_share_{w}m": f"{mm} / nullif({agg('sum', 'total_amt', W12)}, 0)",
        f"rfm_monetary_delta_{w}m": f"{mm} - {agg('sum', 'total_amt', W12)} * ({w} / 12.0)",
    }
family("d9_rfm_short_windows", ["rfm"], short)
family("d10_recency_weight", ["rfm"], {
    "rfm_recency_exp_weighted": f"sum(exp(-date_diff('day', date, ref_date) / 45.0)) FILTER (WHERE {W12})",
})


def qcut_sql(x: str, prefix: str, probs: str, k: int) -> str:
    """CTEs for distinct quantile edges of ``x`` per reference date over relation ``v``."""
    return (
        f"{prefix}e AS (SELECT ref_date, list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), {probs}))) AS e "
        f"FROM v WHERE {x} IS NOT NULL GROUP BY ref_date)"
    )


def code_sql(x: str, e: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL AND len({e}) > 1 THEN "
        f"len(list_filter({e}[2:len({e}) - 1], lambda z: z < {x})) END"
    )


FIVE = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
RFM_V = (
    f"{PIT}, v AS (SELECT cust_id, ref_date, date_diff('day', max(date) FILTER (WHERE {W12}), ref_date) AS r, "
    f"{n(W12)} AS f, {agg('sum', 'total_amt', W12)} AS m FROM j {G}), "
    + ", ".join(qcut_sql(c, c, FIVE, 5) for c in "rfm")
    + ", s AS (SELECT v.cust_id, v.ref_date, v.r, "
    f"len(re.e) - 1 - {code_sql('v.r', 're.e')} AS rs, {code_sql('v.f', 'fe.e')} + 1 AS fs, "
    f"{code_sql('v.m', 'me.e')} + 1 AS ms FROM v LEFT JOIN re USING (ref_date) LEFT JOIN fe USING (ref_date) "
    "LEFT JOIN me USING (ref_date))"
)
SEG = "CASE WHEN r IS NULL THEN NULL WHEN rs IS NULL OR fs IS NULL OR ms IS NULL THEN 'Lost' " + " ".join(
    f"WHEN rs BETWEEN {a[0]} AND {a[1]} AND fs BETWEEN {b[0]} AND {b[1]} AND ms BETWEEN {c[0]} AND {c[1]} THEN '{k}'"
    for k, (a, b, c, _) in rfm.SEGMENTS.items()
) + " ELSE 'Lost' END"
query("e4_quantile_scores", f"{RFM_V} SELECT cust_id, ref_date, CAST(rs AS DOUBLE) AS rfm_r_score, "
      "CAST(fs AS DOUBLE) AS rfm_f_score, CAST(ms AS DOUBLE) AS rfm_m_score FROM s")(
    lambda s, p: table(s, p, ["rfm"], relative=True).select(*KEYS, "rfm_r_score", "rfm_f_score", "rfm_m_score")
)
query("e5_rfm_segments", f"{RFM_V}, g AS (SELECT *, {SEG} AS seg FROM s) SELECT cust_id, ref_date, "
      "CASE WHEN r IS NOT NULL THEN round(0.15 * coalesce(rs, 1) + 0.45 * coalesce(fs, 1) + 0.40 * coalesce(ms, 1), 6) "
      "+ 0.0 END::DOUBLE AS rfm_score, seg AS rfm_segment, CAST(CASE seg "
      + " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in rfm.SEGMENTS.items())
      + " END AS DOUBLE) AS rfm_segment_encoded FROM g")(
    lambda s, p: rounded(table(s, p, ["rfm"], relative=True), ["rfm_score", "rfm_segment", "rfm_segment_encoded"])
)

# ---------------------------------------------------------------- behaviour

change, trend6 = {}, []
for label, now, before in (("1m", W1, P1), ("3m", W3, P3), ("6m", W6, P6)):
    for what, r, p in (
        ("txn_count", n(now), n(before)),
        ("amt", agg("sum", "total_amt", now), agg("sum", "total_amt", before)),
        ("products", agg("avg", PRODUCTS, now), agg("avg", PRODUCTS, before)),
    ):
        vals = {"recent": r, "previous": p, "change_pct": f"({r} - {p}) / CAST({p} + 1 AS DOUBLE) * 100",
                "change_ratio": f"{r} / nullif({p} + 1e-9, 0)"}
        for kind, e in vals.items():
            change[f"behavior_{what}_{kind}_{label}"] = e
            if label == "3m" and kind != "change_ratio":
                change[f"behavior_{what}_{kind}"] = e
# Ratios against a previous value of zero are of the order 1e9 and more.
family("d11_period_change", ["behavior"], change, coarse=[k for k in change if "ratio" in k])
query("b3_previous_window", sql_rounded(PIT, {
    "previous_1": n(P1), "previous_3": n(P3), "previous_6": n(P6), "old_3": n(OLD), "__from": f"FROM j {G}"}))(
    lambda s, p: rounded(table(s, p, ["behavior"]).select(
        *KEYS, F.col("behavior_txn_count_previous_1m").alias("previous_1"),
        F.col("behavior_txn_count_previous_3m").alias("previous_3"),
        F.col("behavior_txn_count_previous_6m").alias("previous_6"),
        ).join(_old_rows(s, p), KEYS, "left"))
)


def _old_rows(spark, path):
    from ebbtide.features.panel import Aggregates, aggregate, point_in_time

    a = Aggregates()
    col = a.rows("old")
    return aggregate(point_in_time(history(spark, path), cohort(spark, path)), a).select(*KEYS, col.alias("old_3"))


family("d12_cross_window_share", ["behavior"], {
    "behavior_txn_recent_share_1m_over_6m": f"{n(W1)} / ({n(W6)} / 6.0)",
    "behavior_amt_recent_share_1m_over_6m":
        f"{agg('sum', 'total_amt', W1)} / nullif({agg('sum', 'total_amt', W6)} / 6.0, 0)",
})
TREND = (
    f"CASE WHEN {n(W12)} IS NULL THEN NULL WHEN ({change['behavior_txn_count_change_pct_3m']}) IS NULL OR "
    f"({change['behavior_amt_change_pct_3m']}) IS NULL THEN 0 "
    f"WHEN ({change['behavior_txn_count_change_pct_3m']}) < -20 OR ({change['behavior_amt_change_pct_3m']}) < -20 OR "
    f"coalesce(({change['behavior_txn_count_change_pct_1m']}) < -30, false) THEN -1 "
    f"WHEN ({change['behavior_txn_count_change_pct_3m']}) > 20 OR ({change['behavior_amt_change_pct_3m']}) > 20 THEN 1 "
    "ELSE 0 END"
)
family("d13_trend_class", ["behavior"], {"behavior_activity_trend": TREND})
family("d14_volatility", ["behavior"], {
    "behavior_volatility_score": f"CASE WHEN {n(W12)} IS NOT NULL THEN ("
    + " + ".join(f"coalesce(abs({change[f'behavior_{w}_change_pct_{k}']}), 0)" for k in ("1m", "3m", "6m")
                 for w in ("txn_count", "amt")) + ") / 6.0 END",
})

# ---------------------------------------------------------------- lifecycle

PITC = f"{PIT}, jc AS (SELECT j.*, customers.tenure, customers.age FROM j LEFT JOIN customers USING (cust_id))"
GT = "FROM jc GROUP BY cust_id, ref_date, tenure"
LIFE = {
    "lifecycle_tenure_days": "tenure * 30",
    "lifecycle_days_since_first_txn": "date_diff('day', min(date), ref_date)",
    "lifecycle_txn_per_month": "count(*) / CAST(tenure + 1 AS DOUBLE)",
    "lifecycle_products_per_year": agg("avg", PRODUCTS, W12),
}
family("d15_lifecycle_base", ["lifecycle"], LIFE, ctes=PITC, tail=GT)
life_w = {}
for w in (3, 6):
    life_w |= {
        f"lifecycle_txn_per_month_{w}m": f"{n(WS[w])} / {w}.0",
        f"lifecycle_txn_share_{w}m": f"{n(WS[w])} / CAST(count(*) + 1 AS DOUBLE)",
        f"lifecycle_products_avg_{w}m": agg("avg", PRODUCTS, WS[w]),
    }
family("d16_lifecycle_windows", ["lifecycle"], life_w)
GRID = (
    f"{PIT}, mon AS (SELECT DISTINCT ref_date, month FROM j), who AS (SELECT DISTINCT cust_id, ref_date FROM j), "
    "cell AS (SELECT cust_id, ref_date, month, count(*) AS c FROM j GROUP BY ALL), "
    "grid AS (SELECT who.cust_id, who.ref_date, mon.month, coalesce(cell.c, 0) AS c FROM who JOIN mon USING (ref_date) "
    "LEFT JOIN cell ON cell.cust_id = who.cust_id AND cell.ref_date = who.ref_date AND cell.month = mon.month)"
)
family("d17_monthly_consistency", ["lifecycle"], {
    "lifecycle_activity_consistency": "1 / (stddev_samp(c) / (avg(c) + 1) + 1)"}, ctes=GRID, tail=f"FROM grid {G}")
PEAK = (
    f"{PIT}, a AS (SELECT cust_id, ref_date, month, count(*) AS c, count(*) FILTER (WHERE {W6}) AS c6 FROM j GROUP BY ALL), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY cust_id, ref_date ORDER BY c DESC, month) AS r, "
    "row_number() OVER (PARTITION BY cust_id, ref_date ORDER BY c6 DESC, month) AS r6 FROM a)"
)
family("d18_peak_month", ["lifecycle", "timing"], {
    "lifecycle_days_since_peak": "max(CASE WHEN r6 = 1 AND c6 > 0 THEN date_diff('day', CAST(month AS DATE), ref_date) END)",
    "time_days_since_peak_activity": "max(CASE WHEN r = 1 THEN date_diff('day', CAST(month AS DATE), ref_date) END)",
}, ctes=PEAK, tail=f"FROM p {G}")
a6, b6 = agg("sum", "total_amt", W6), agg("sum", "total_amt", P6)
family("d19_half_year_trend", ["lifecycle"], {
    "lifecycle_txn_trend_6m": f"({n(W6)} - {n(P6)}) / CAST({n(P6)} + 1 AS DOUBLE)",
    "lifecycle_amt_trend_6m": f"({a6} - {b6}) / ({b6} + 1)",
})
RATE = "(count(*) / CAST(tenure + 1 AS DOUBLE))"
family("d20_lifecycle_stage", ["lifecycle"], {
    "lifecycle_stage": f"CASE WHEN tenure IS NULL THEN 0 WHEN tenure * 30 < 180 THEN CASE WHEN {RATE} > 2 THEN 1 ELSE 2 END "
    f"WHEN tenure * 30 < 730 THEN CASE WHEN {RATE} > 3 THEN 3 ELSE 4 END ELSE CASE WHEN {RATE} > 2 THEN 5 ELSE 6 END END",
}, ctes=PITC, tail=GT)

# ---------------------------------------------------------------- winsorizing

RAW_TREND = {
    "behavior_txn_count_change_ratio_3m": (change["behavior_txn_count_change_ratio_3m"], True),
    "behavior_activity_trend": (TREND, True),
    "lifecycle_amt_trend_6m": (f"({a6} - {b6}) / ({b6} + 1)", False),
    "time_activity_acceleration_1m_vs_3m": (f"{n(W1)} / ({n(W3)} / 3.0 + 1e-9) - 1", False),
}
WIN = (
    f"{PIT}, v AS (SELECT cust_id, ref_date, {n(W12)} AS n12, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS raw_{k}" for k, (e, _) in RAW_TREND.items())
    + f" FROM j {G}), f AS (SELECT cust_id, ref_date, "
    + ", ".join(
        f"CASE WHEN n12 IS NOT NULL THEN coalesce(raw_{k}, -999) END AS {k}" if year else f"coalesce(raw_{k}, -999) AS {k}"
        for k, (_, year) in RAW_TREND.items())
    # Cohort customers without history count in the percentiles of the families keyed by the customer table.
    + " FROM v), fa AS (SELECT * FROM f UNION ALL SELECT cust_id, ref_date, "
    + ", ".join(f"CAST({'NULL' if year else '-999'} AS DOUBLE) AS {k}" for k, (_, year) in RAW_TREND.items())
    + " FROM cohort WHERE (cust_id, ref_date) NOT IN (SELECT cust_id, ref_date FROM v)), q AS (SELECT ref_date, "
    + ", ".join(f"quantile_cont({k}, 0.01) AS lo_{k}, quantile_cont({k}, 0.99) AS hi_{k}, count({k}) AS n_{k}"
                for k in RAW_TREND)
    + " FROM fa GROUP BY ref_date)"
)
query("d21_winsorize", WIN + " SELECT cust_id, ref_date, "
      + ", ".join(f"round(coalesce(CASE WHEN {k} IS NOT NULL AND n_{k} >= 5 THEN greatest(least({k}, hi_{k}), lo_{k}) "
                  f"ELSE {k} END, -999), 4) + 0.0 AS {k}" for k in RAW_TREND)
      + " FROM f JOIN q USING (ref_date)")(
    lambda s, p: rounded(table(s, p, ["behavior", "lifecycle", "timing"], winsorize=True, sentinel=True),
                         list(RAW_TREND), digits=4)
)

# ---------------------------------------------------------------- time patterns

act = {"time_inactive_months_last_12m":
       f"CASE WHEN {n(W12)} IS NOT NULL THEN greatest(12 - count(DISTINCT month) FILTER (WHERE {W12}), 0) END"}
for w in (1, 3, 6):
    c = WS[w]
    act |= {
        f"time_txn_count_last_{w}m": n(c),
        f"time_txn_per_month_last_{w}m": f"{n(c)} / {w}.0",
        f"time_active_months_last_{w}m": f"nullif(count(DISTINCT month) FILTER (WHERE {c}), 0)",
        f"time_inactive_months_last_{w}m":
            f"CASE WHEN {n(c)} IS NOT NULL THEN greatest({w} - count(DISTINCT month) FILTER (WHERE {c}), 0) END",
        f"time_activity_share_last_{w}m": f"{n(c)} / ({n(W12)} / 12.0 + 1e-9)",
    }
family("d22_activity_windows", ["timing"], act)
family("d23_inactivity", ["timing"], {
    "time_inactive_months_last_12m": act["time_inactive_months_last_12m"],
    "time_consecutive_inactive_months":
        f"CASE WHEN {n(W12)} IS NOT NULL THEN least(greatest((year(ref_date) * 12 + month(ref_date)) - "
        f"max(year(date) * 12 + month(date)) FILTER (WHERE {W12}), 0), 12) END",
})
family("d24_decay", ["timing"], {
    "time_activity_decay_rate": f"({n(OLD)} - {n(W3)}) / CAST({n(OLD)} + 1 AS DOUBLE)",
    "time_activity_acceleration_1m_vs_3m": f"{n(W1)} / ({n(W3)} / 3.0 + 1e-9) - 1",
})
GAPS = (
    f"{PIT}, d AS (SELECT cust_id, ref_date, date, date_diff('day', lag(date) OVER (PARTITION BY cust_id, ref_date "
    "ORDER BY date), date) AS gap FROM j), "
    + ", ".join(
        f"d{w} AS (SELECT cust_id, ref_date, avg(gap) AS g{w} FROM (SELECT cust_id, ref_date, date_diff('day', lag(date) "
        f"OVER (PARTITION BY cust_id, ref_date ORDER BY date), date) AS gap FROM j WHERE {WS[w]}) {G})" for w in (1, 3, 6))
    + f", a AS (SELECT cust_id, ref_date, avg(gap) AS g FROM d {G})"
)
query("e2_mean_gap", GAPS + " SELECT cust_id, ref_date, "
      + ", ".join(f"round(g{w}, 6) + 0.0 AS time_avg_days_between_txn_last_{w}m" for w in (1, 3, 6))
      + ", round(g, 6) + 0.0 AS time_avg_days_between_txn FROM a "
      + " ".join(f"LEFT JOIN d{w} USING (cust_id, ref_date)" for w in (1, 3, 6)))(
    lambda s, p: rounded(table(s, p, ["timing"]),
                         [f"time_avg_days_between_txn_last_{w}m" for w in (1, 3, 6)] + ["time_avg_days_between_txn"])
)
family("e3_last_two_dates", ["timing"], {
    "time_days_between_last_two_txn":
        "date_diff('day', max(CASE WHEN r = 2 THEN date END), max(CASE WHEN r = 1 THEN date END))"},
    ctes=f"{PIT}, k AS (SELECT *, row_number() OVER (PARTITION BY cust_id, ref_date ORDER BY date DESC) AS r FROM j)",
    tail=f"FROM k {G}")

# ---------------------------------------------------------------- churn risk (opt-in family)

now3, pre3 = agg("sum", "total_amt", W3), agg("sum", "total_amt", P3)
decl = f"({now3} - {pre3}) / ({pre3} + 1) * 100"
family("d25_spending_decline", ["risk"], {
    "churn_spending_decline_3m_vs_6m": decl,
    "churn_severe_decline_flag": f"CASE WHEN {n(W3)} IS NOT NULL OR {n(P3)} IS NOT NULL THEN "
    f"CASE WHEN coalesce({decl} < -50, false) THEN 1 ELSE 0 END END",
})
sz, pz = f"({now3} / ({n(W3)} + 1))", f"({pre3} / ({n(P3)} + 1))"
family("d26_frequency_size_drop", ["risk"], {
    "churn_txn_frequency_drop_pct": f"({n(W3)} - {n(P3)}) / CAST({n(P3)} + 1 AS DOUBLE) * 100",
    "churn_avg_txn_size_drop_pct": f"({sz} - {pz}) / ({pz} + 1) * 100",
})
family("d27_product_abandonment", ["risk"], {
    "churn_product_abandonment_count":
        f"len(list_filter(coalesce(list(DISTINCT {PRODUCTS}) FILTER (WHERE {P6}), []), lambda z: NOT list_contains("
        f"coalesce(list(DISTINCT {PRODUCTS}) FILTER (WHERE {W6}), []), z)))"})
query("f5_value_set_difference", f"{PIT}, a AS (SELECT DISTINCT cust_id, ref_date, {PRODUCTS} AS v FROM j WHERE {P6} "
      f"EXCEPT SELECT DISTINCT cust_id, ref_date, {PRODUCTS} FROM j WHERE {W6}) SELECT cust_id, ref_date, "
      f"CAST(count(*) AS DOUBLE) AS lost FROM a {G}")(
    lambda s, p: table(s, p, ["risk"]).where("churn_product_abandonment_count > 0")
    .select(*KEYS, F.col("churn_product_abandonment_count").cast("double").alias("lost"))
)
MON = (
    f"{PIT}, m AS (SELECT cust_id, ref_date, month, sum(total_amt) AS y, year(month) * 12 + month(month) AS x FROM j "
    f"WHERE {W12} GROUP BY ALL)"
)
family("d29_calendar_slope", ["risk"], {
    "churn_balance_decline_velocity": "max(z)"},
    ctes=f"{MON}, z AS (SELECT cust_id, ref_date, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(y, x) END AS z FROM m {G} "
    "UNION ALL SELECT DISTINCT cust_id, ref_date, NULL FROM j)",
    tail=f"FROM z {G}", coarse=["churn_balance_decline_velocity"])


def chan(w):
    return (f"(max(CASE WHEN {EFT_AMT} > 0 THEN 1 ELSE 0 END) FILTER (WHERE {w}) + "
            f"max(CASE WHEN {CC_AMT} > 0 THEN 1 ELSE 0 END) FILTER (WHERE {w}))")


family("d31_channel_drop", ["risk"], {"churn_channel_diversity_drop": f"{chan(P3)} - {chan(W3)}"})
LEVEL = (
    f"{PIT}, v AS (SELECT cust_id, ref_date, {n(W3)} AS n1, {n(P3)} AS n0, {now3} AS m1, {pre3} AS m0, "
    f"date_diff('day', max(date) FILTER (WHERE {W3}), ref_date) AS r1, "
    f"date_diff('day', max(date) FILTER (WHERE {P3}), CAST(ref_date - INTERVAL 3 MONTH AS DATE)) AS r0 FROM j {G}), "
    "q AS (SELECT ref_date, quantile_cont(CAST(n1 AS DOUBLE), .95) AS qn1, quantile_cont(CAST(n0 AS DOUBLE), .95) AS qn0, "
    "quantile_cont(m1, .95) AS qm1, quantile_cont(m0, .95) AS qm0 FROM v GROUP BY ref_date), "
    "l AS (SELECT cust_id, ref_date, "
    + ", ".join(
        f"0.3 * (1 - r{i} / 180.0) + 0.4 * greatest(least(n{i} / qn{i}, 1), 0) + 0.3 * greatest(least(m{i} / qm{i}, 1), 0) "
        f"+ 0 * m{i} AS l{i}" for i in (0, 1))
    + " FROM v JOIN q USING (ref_date))"
)
query("d32_rfm_decay", f"{LEVEL} SELECT cust_id, ref_date, round(l0 - l1, 6) + 0.0 AS churn_rfm_decay_rate FROM l")(
    lambda s, p: rounded(table(s, p, ["risk"], relative=True), ["churn_rfm_decay_rate"])
)
query("c11_present_in_both", f"{LEVEL} SELECT cust_id, ref_date FROM l WHERE l0 IS NOT NULL AND l1 IS NOT NULL")(
    lambda s, p: table(s, p, ["risk"], relative=True).where("churn_rfm_decay_rate is not null").select(*KEYS)
)
query("d33_peak_quarter", f"{GRID}, r AS (SELECT cust_id, ref_date, sum(c) OVER (PARTITION BY cust_id, ref_date ORDER BY "
      "month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM grid), "
      f"p AS (SELECT cust_id, ref_date, max(c3) AS pk FROM r {G}), k AS (SELECT cust_id, ref_date, {n(W3)} AS c FROM j {G}) "
      "SELECT cust_id, ref_date, round(c / CAST(pk + 1 AS DOUBLE), 6) + 0.0 AS churn_current_to_peak_activity_ratio "
      "FROM k JOIN p USING (cust_id, ref_date)")(
    lambda s, p: rounded(table(s, p, ["risk"], relative=True), ["churn_current_to_peak_activity_ratio"])
)
AGEQ = (
    f"{PITC}, v AS (SELECT cust_id, ref_date, any_value(age) AS age, date_diff('day', max(date), ref_date) AS rec FROM jc "
    f"{G}), {qcut_sql('age', 'a', '[0.0, 0.25, 0.5, 0.75, 1.0]', 4)}, "
    f"k AS (SELECT v.*, {code_sql('v.age', 'ae.e')} AS quart FROM v JOIN ae USING (ref_date))"
)
query("e6_rank_in_segment", f"{AGEQ} SELECT cust_id, ref_date, round((rank() OVER w + (count(*) OVER (PARTITION BY ref_date, "
      "quart, rec) - 1) / 2.0) / count(*) OVER (PARTITION BY ref_date, quart), 6) + 0.0 "
      "AS churn_recency_percentile_in_age_segment FROM k WINDOW w AS (PARTITION BY ref_date, quart ORDER BY rec)")(
    lambda s, p: rounded(table(s, p, ["risk"], relative=True), ["churn_recency_percentile_in_age_segment"])
)

# ---------------------------------------------------------------- performance family

LW3 = "date >= ref_date - INTERVAL 3 MONTH"
LP3 = "date >= ref_date - INTERVAL 6 MONTH AND date < ref_date - INTERVAL 3 MONTH"
LW6 = "date >= ref_date - INTERVAL 6 MONTH"
family("b2_left_closed_window", ["performance"], {
    "activity_drop_ratio": f"coalesce({agg('sum', 'total_cnt', LW3)}, 0) / greatest(coalesce({agg('sum', 'total_cnt', LP3)}, 0), 1)",
})
family("d34_activity_drop", ["performance"], {
    "activity_drop_ratio": f"coalesce({agg('sum', 'total_cnt', LW3)}, 0) / greatest(coalesce({agg('sum', 'total_cnt', LP3)}, 0), 1)",
    "days_since_last_txn": "date_diff('day', max(date), ref_date)",
})
family("d28_distinct_product_drop", ["performance"], {
    "product_abandonment": f"1 - count(DISTINCT {PRODUCTS}) FILTER (WHERE {LW3}) / "
    f"CAST(greatest(count(DISTINCT {PRODUCTS}) FILTER (WHERE {LW6}), 1) AS DOUBLE)",
})
family("d30_ordinal_slope", ["performance"], {
    "balance_trend": "CASE WHEN count(*) >= 3 THEN regr_slope(y, x) ELSE 0 END"},
    ctes=f"{PIT}, m AS (SELECT cust_id, ref_date, month, sum(total_amt) AS y, row_number() OVER (PARTITION BY cust_id, "
    "ref_date ORDER BY month) - 1 AS x FROM j GROUP BY cust_id, ref_date, month)", tail=f"FROM m {G}", coarse=["balance_trend"])
family("d35_irregularity", ["performance"], {
    "txn_irregularity": "coalesce(stddev_samp(total_cnt) / (avg(total_cnt) + 1e-9), 0)"})
PEER = (
    f"{PIT}, v AS (SELECT cust_id, ref_date, date_diff('day', min(date), ref_date) AS t, sum(total_cnt) AS c, "
    f"sum(total_amt) AS m FROM j {G}), b AS (SELECT *, CASE WHEN t > 0 AND t <= 90 THEN 1 WHEN t > 90 AND t <= 180 THEN 2 "
    "WHEN t > 180 AND t <= 365 THEN 3 WHEN t > 365 AND t <= 730 THEN 4 WHEN t > 730 AND t <= 10000 THEN 5 END AS br FROM v), "
    "md AS (SELECT ref_date, median(c) AS mc FROM v GROUP BY ref_date), "
    "pm AS (SELECT ref_date, br, median(m) AS mm, count(*) AS nn FROM b WHERE br IS NOT NULL GROUP BY ref_date, br)"
)
query("d36_new_joiner", f"{PEER} SELECT cust_id, ref_date, CASE WHEN t < 180 AND c > mc THEN 1.0 ELSE 0.0 END::DOUBLE "
      "AS new_joiner_risk FROM v JOIN md USING (ref_date)")(
    lambda s, p: rounded(table(s, p, ["performance"], relative=True), ["new_joiner_risk"])
)
query("d37_below_peer", f"{PEER} SELECT b.cust_id, b.ref_date, CASE WHEN nn > 10 AND m < mm * 0.5 THEN 1.0 ELSE 0.0 "
      "END::DOUBLE AS below_peer_flag FROM b LEFT JOIN pm ON pm.ref_date = b.ref_date AND pm.br = b.br")(
    lambda s, p: rounded(table(s, p, ["performance"], relative=True), ["below_peer_flag"])
)
family("e7_inactivity_streak", ["performance", "risk"], {
    "consecutive_inactive_months": "least((year(ref_date) * 12 + month(ref_date)) - max(year(date) * 12 + month(date)), 6)",
    "churn_consecutive_months_no_activity":
        f"(year(ref_date) * 12 + month(ref_date)) - max(year(date) * 12 + month(date)) FILTER (WHERE {W12})",
})

# ---------------------------------------------------------------- demographics and assembly

GROUPS = (
    "CASE WHEN age > 0 AND age <= 25 THEN '18-25' WHEN age <= 35 AND age > 0 THEN '26-35' WHEN age <= 45 AND age > 0 THEN "
    "'36-45' WHEN age <= 55 AND age > 0 THEN '46-55' WHEN age <= 65 AND age > 0 THEN '56-65' WHEN age <= 100 AND age > 0 "
    "THEN '65+' ELSE 'nan' END AS age_group, CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-1y' WHEN tenure > 12 AND tenure "
    "<= 36 THEN '1-3y' WHEN tenure > 36 AND tenure <= 60 THEN '3-5y' WHEN tenure > 60 AND tenure <= 120 THEN '5-10y' WHEN "
    "tenure > 120 AND tenure <= 400 THEN '10y+' ELSE 'nan' END AS tenure_group"
)
CATS = ("gender", "province", "religion", "work_type", "work_sector", "age_group", "tenure_group")


@query("g8_right_closed_bins", f"WITH {CUSTOMERS_SQL.strip()} SELECT cust_id, {GROUPS} FROM customers")
def g8_right_closed_bins(spark, path):
    from ebbtide.features.demographics import with_groups

    return with_groups(customers(spark, path)).select("cust_id", "age_group", "tenure_group")


query("g9_label_codes", f"WITH {CUSTOMERS_SQL.strip()}, g AS (SELECT *, {GROUPS} FROM customers) SELECT cust_id, age, tenure, "
      + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_encoded" for c in CATS) + " FROM g")(
    lambda s, p: demographics(customers(s, p))
)
query("c4_demographic_lookup", f"{PITC} SELECT cust_id, ref_date, CAST(any_value(age) AS DOUBLE) AS age, "
      f"CAST(any_value(tenure) AS DOUBLE) AS tenure FROM jc {G}")(
    lambda s, p: rounded(table(s, p, ["recency"], with_demographics=True), ["age", "tenure"])
)
COHORT_MONTHS = f"{PIT} SELECT ref_date, CAST(count(DISTINCT month) AS BIGINT) AS months FROM j GROUP BY ref_date"
query("g2_month_buckets", COHORT_MONTHS)(
    lambda s, p: cohort_months(history(s, p), cohort(s, p)).groupBy("ref_date").agg(F.count(F.lit(1)).alias("months"))
)
query("c3_family_alignment", sql_rounded(PIT, {
    "rfm_frequency_count": f"coalesce({n(W12)}, -999)", "behavior_amt_recent_3m": f"coalesce({now3}, -999)",
    "time_txn_count_last_1m": f"coalesce({n(W1)}, -999)", "__from": f"FROM j {G}"}))(
    lambda s, p: rounded(table(s, p, ["rfm", "behavior", "timing"], sentinel=True).select(
        *KEYS, "rfm_frequency_count", "behavior_amt_recent_3m", "time_txn_count_last_1m"))
)


def full_features(spark, path, dates=adapters.REF_DATES):
    return feature_table(history(spark, path), customers(spark, path), cohort(spark, path, dates))


@query("c6_labelled_features", f"{PIT}, k AS (SELECT cust_id, ref_date, {n(W3)} AS n3, {agg('sum', 'total_amt', W12)} AS m12 "
       f"FROM j {G}) SELECT k.cust_id, k.ref_date, cohort.churn, round(CAST(coalesce(n3, -999) AS DOUBLE), 6) + 0.0 AS "
       "active_months_3m, round(coalesce(m12, -999), 6) + 0.0 AS rfm_monetary_value FROM k JOIN cohort "
       "ON cohort.cust_id = k.cust_id AND cohort.ref_date = k.ref_date")
def c6_labelled_features(spark, path):
    full = attach_labels(full_features(spark, path), cohort(spark, path))
    return full.select(
        *KEYS, "churn", (F.round("active_months_3m", 6) + F.lit(0.0)).alias("active_months_3m"),
        (F.round("rfm_monetary_value", 6) + F.lit(0.0)).alias("rfm_monetary_value"))


def every_row(spark, path) -> DataFrame:
    """All cohort rows get features; those without any history have the sentinel where others have a value."""
    given = feature_table(history(spark, path), customers(spark, path), cohort(spark, path), ["rfm"], keep_unknown=True)
    filled = F.lit(True)
    for c in ("rfm_recency_days", "rfm_frequency_count", "rfm_monetary_value"):
        filled = filled & F.col(c).isNotNull()
    return given.agg(F.count(F.lit(1)).alias("rows"), F.every(filled).alias("all_filled"))


query("c7_rows_without_history", PIT + " SELECT count(*) AS rows, true AS all_filled FROM cohort")(lambda s, p: every_row(s, p))
query("c7_lookup_default", sql_rounded(PIT, {
    "days_since_last_txn": "coalesce(date_diff('day', max(date), ref_date), 0)",
    "txn_irregularity": "coalesce(stddev_samp(total_cnt) / (avg(total_cnt) + 1e-9), 0)", "__from": f"FROM j {G}"}))(
    lambda s, p: rounded(table(s, p, ["performance"], sentinel=True), ["days_since_last_txn", "txn_irregularity"])
)
B1_SQL = ("WITH e AS (SELECT user_id AS cust_id, CAST(ts AS DATE) AS date, CAST(sum(CASE WHEN event_type IN "
      "('purchase', 'signup') THEN floor(value) ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN event_type IN ('click', 'view') "
      "THEN floor(value) ELSE 0 END) AS DOUBLE) AS b FROM events GROUP BY ALL), c AS (SELECT DISTINCT cust_id, (SELECT max(date) "
      "FROM e) AS ref_date FROM e) SELECT c.cust_id, c.ref_date, "
      + ", ".join(f"CAST(nullif(count(*) FILTER (WHERE e.date > ref_date - {w}), 0) AS DOUBLE) AS active_months_{w}m, "
                  f"sum(a) FILTER (WHERE e.date > ref_date - {w}) AS {EFT_AMT}_sum_{w}m" for w in (1, 3, 6, 12))
      + " FROM c JOIN e ON e.cust_id = c.cust_id AND e.date <= c.ref_date GROUP BY c.cust_id, c.ref_date")



@query("b1_window_days", B1_SQL)
def b1_window_days(spark, path):
    h = adapters.event_history(spark, path)
    last = h.agg(F.max("date")).first()[0]
    c = h.select("cust_id").distinct().withColumn("ref_date", F.lit(last))
    t = feature_table(h, h.select("cust_id"), c, ["windows"], unit="day", with_demographics=False, sentinel=False)
    return t.select(*KEYS, *[x for w in (1, 3, 6, 12) for x in (
        F.col(f"active_months_{w}m").cast("double").alias(f"active_months_{w}m"), F.col(f"{EFT_AMT}_sum_{w}m"))])

