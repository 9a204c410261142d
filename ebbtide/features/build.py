"""Assemble families into one feature table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.features import base, behavior, lifecycle, performance, rfm, risk, timing
from ebbtide.features.demographics import demographics
from ebbtide.features.panel import KEYS, MEASURES, Aggregates, aggregate, point_in_time, tasks_for
from ebbtide.functions.periods import month_number
from ebbtide.functions.safe import SENTINEL, fill
from ebbtide.operators.quantiles import column_percentiles
from ebbtide.operators.ranks import average_ranks
from ebbtide.runtime import materialize

FAMILIES = {
    "windows": base.windows,
    "trend": base.trend,
    "recency": base.recency,
    "patterns": base.patterns,
    "deciles": base.decile_signals,
    "season": base.season,
    "rfm": rfm.values,
    "behavior": behavior.change,
    "lifecycle": lifecycle.lifecycle,
    "timing": timing.timing,
    "performance": performance.performance,
    "risk": risk.risk,
}
DEFAULT = tuple(f for f in FAMILIES if f != "risk")
PLAIN_DEFAULTS = {"performance"}
WINSOR = (0.01, 0.99)
WINSOR_MIN = 5


def cohort_months(history: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every month with a row of any cohort customer up to the reference date: (ref_date, month_no, place)."""
    months = history.select("cust_id", F.last_day("date").alias("m"), "date")
    joined = cohort.select(*KEYS).distinct().join(months, "cust_id").where(F.col("date") <= F.col("ref_date"))
    seen = joined.groupBy("ref_date", month_number(F.col("m")).alias("month_no")).agg(F.count(F.lit(1)).alias("_c"))
    # One small sorted array of months per reference date.
    arr = seen.groupBy("ref_date").agg(F.sort_array(F.collect_set("month_no")).alias("_m"))
    return arr.select("ref_date", F.posexplode("_m").alias("place", "month_no"))


def winsor_targets(columns: Sequence[str]) -> list[str]:
    """Columns named like a trend or a ratio ("acceleration" contains "ratio" and is one of them)."""
    return [c for c in columns if "trend" in c.lower() or "ratio" in c.lower() or "_DIV_" in c]


def feature_table(
    history: DataFrame,
    customers: DataFrame,
    cohort: DataFrame,
    families: Sequence[str] = DEFAULT,
    unit: str = "month",
    keyed: bool = False,
    codes=None,
    with_demographics: bool = True,
    winsorize: bool = True,
    relative: bool = True,
    sentinel: bool = True,
    keep_unknown: bool = False,
) -> DataFrame:
    """Features of every (cust_id, ref_date) of the cohort with at least one history row up to its date.

    ``keep_unknown`` keeps the others too, with the sentinel and the defaults of what has none: pass it to score every
    row of a cohort.

    Cohort-relative features (scores, percentiles, medians) are relative to the cohort given: call it for the
    training and the scoring cohort separately. ``relative=False`` leaves those columns out.
    """
    families = list(families)
    # Written, as several branches read them; their sizes then decide the number of tasks.
    history = materialize(history.select("cust_id", "date", *MEASURES))
    cohort = materialize(cohort.select(*KEYS).distinct())
    tasks = tasks_for(cohort, history)
    joined = point_in_time(history, cohort, unit, keyed, tasks=tasks)
    a = Aggregates()
    columns: dict[str, Column] = {}
    owner: dict[str, str] = {}
    for fam in families:
        for name, col in FAMILIES[fam](a).items():
            columns[name] = col
            owner[name] = fam
    known = a.latest("row_no").isNotNull()
    year = a.rows("12").isNotNull()
    agg = aggregate(joined, a)

    months = None
    if {"lifecycle", "risk"} & set(families):
        months = materialize(cohort_months(history, cohort))
    if "lifecycle" in families:
        agg = agg.join(months.groupBy("ref_date").agg(F.count(F.lit(1)).alias("cohort_months")), "ref_date", "left")
    if {"lifecycle", "timing", "risk"} & set(families) or with_demographics:
        people = demographics(customers, codes) if with_demographics else customers.select("cust_id", "age", "tenure")
        agg = agg.join(people, "cust_id", "left")
    extra = [c for c in agg.columns if c in ("age", "tenure") or c.endswith("_encoded")]
    table = agg.select(
        *KEYS,
        known.alias("_known"),
        year.alias("_year"),
        *extra,
        *[c.alias(n) for n, c in columns.items()],
    )
    if "risk" in families and relative:
        table = table.join(risk.peak_quarter(history, cohort, months, tasks), KEYS, "left")

    clipped = [
        c
        for c in winsor_targets(list(columns))
        if winsorize and owner[c] in ("rfm", "behavior", "lifecycle", "timing")
    ]
    scored = {"rfm", "performance", "risk"} & set(families) if relative else set()
    if scored or clipped:
        table = materialize(table)
        table = _cohort_relative(table, scored, clipped, {c: owner[c] for c in clipped})
    if "risk" in scored:
        table = _recency_rank(table)

    made = [c for c in table.columns if not c.startswith("_") and c not in KEYS]
    if not keep_unknown:
        table = table.where("_known")
    plain = {n for n, f in owner.items() if f in PLAIN_DEFAULTS} | {"new_joiner_risk", "below_peer_flag"}
    if not sentinel:
        return table.select(*KEYS, *made)
    return table.select(
        *KEYS,
        *[
            F.col(c)
            if c == "rfm_segment"
            else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
            if c in plain
            else fill(F.col(c)).alias(c)
            for c in made
        ],
    )


def _cohort_relative(table: DataFrame, relative: set[str], clipped: list[str], owner: dict[str, str]) -> DataFrame:
    """Everything that compares a customer with the rest of its reference date, from one percentile job."""
    values: dict[str, Column] = {}
    if "rfm" in relative:
        values |= {c: F.col(c) for c in rfm.SCORED.values()}
    if "performance" in relative:
        values["_perf_cnt"] = F.col("_perf_cnt")
        for b in performance.BRACKET_LABELS:
            values[f"_peer_{b}"] = F.when(F.col("_perf_bracket") == b, F.col("_perf_amt"))
    if "risk" in relative:
        values |= {c: F.col(c) for c in ("_risk_n_now", "_risk_n_before", "_risk_amt_now", "_risk_amt_before")}
        values["age"] = F.col("age")

    def family_filled(c: str) -> Column:
        # Gaps inside a family already hold the sentinel when the percentiles are taken.
        filled = F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL))
        return F.when(F.col("_year"), filled) if owner[c] in ("behavior", "rfm") else filled

    values |= {c: family_filled(c) for c in clipped}
    probs = sorted({*rfm.QUINTILES, *WINSOR, 0.25, 0.5, 0.75, 0.95})
    at = {p: i for i, p in enumerate(probs)}

    def q(var: str, p: float) -> Column:
        return F.element_at(F.col(f"`q:{var}`"), at[p] + 1)

    def cuts(var: str, ps: Sequence[float]) -> tuple[Column, Column]:
        return rfm.inner_edges(F.when(F.col(f"`q:{var}`").isNotNull(), F.array(*[q(var, p) for p in ps])))

    # What a row is compared with is worked out on the one-row-per-date table, which is written out: the planner knows
    # its size before it decides to broadcast it.
    small: dict[str, Column] = {}
    if "rfm" in relative:
        for k, c in rfm.SCORED.items():
            small[f"_edges_{k}"], small[f"_bins_{k}"] = cuts(c, rfm.QUINTILES)
    if "performance" in relative:
        small["_median_cnt"] = q("_perf_cnt", 0.5)
        for i, b in enumerate(performance.BRACKET_LABELS):
            crowd = F.col(f"`n:_peer_{b}`") > performance.PEER_MIN
            small[f"_peer_{i}"] = F.when(crowd, q(f"_peer_{b}", 0.5) * F.lit(performance.PEER_SHARE))
    if "risk" in relative:
        for c in ("_risk_n_now", "_risk_n_before", "_risk_amt_now", "_risk_amt_before"):
            small[f"{c}_95"] = q(c, 0.95)
        small["_age_median"] = q("age", 0.5)
        small["_age_edges"], small["_age_bins"] = cuts("age", (0.0, 0.25, 0.5, 0.75, 1.0))
    for i, c in enumerate(clipped):
        enough = F.col(f"`n:{c}`") >= WINSOR_MIN
        small[f"_lo_{i}"] = F.when(enough, q(c, WINSOR[0])).otherwise(F.lit(float("-inf")))
        small[f"_hi_{i}"] = F.when(enough, q(c, WINSOR[1])).otherwise(F.lit(float("inf")))
    stats = column_percentiles(table, "ref_date", values, probs)
    stats = materialize(stats.select("ref_date", *[c.alias(n) for n, c in small.items()]))
    out = table.join(stats, "ref_date", "left")

    new: dict[str, Column] = {}
    if "rfm" in relative:
        out = out.withColumns({
            f"rfm_{k}_score": rfm.score(F.col(c), F.col(f"_edges_{k}"), F.col(f"_bins_{k}"), reverse=k == "r")
            for k, c in rfm.SCORED.items()
        })
        rfm_scores = [F.col(f"rfm_{k}_score") for k in ("r", "f", "m")]
        new["rfm_score"] = F.when(F.col("_year"), rfm.composite(*rfm_scores))
        new["rfm_segment"] = F.when(F.col("_year"), rfm.segment(*rfm_scores))
    if "performance" in relative:
        new["new_joiner_risk"] = (
            (F.col("_perf_tenure_days") < performance.NEW_JOINER_DAYS)
            & (F.coalesce("_perf_cnt", F.lit(0.0)) > F.col("_median_cnt"))
        ).cast("double")
        bar = F.lit(None).cast("double")
        for i, b in enumerate(performance.BRACKET_LABELS):
            bar = F.when(F.col("_perf_bracket") == b, F.col(f"_peer_{i}")).otherwise(bar)
        new["below_peer_flag"] = F.coalesce((F.col("_perf_amt") < bar).cast("double"), F.lit(0.0))
    if "risk" in relative:
        level = [
            risk.rfm_level(
                F.col(f"_risk_rec_{w}"), F.col(f"_risk_n_{w}"), F.col(f"_risk_amt_{w}"),
                F.col(f"_risk_n_{w}_95"), F.col(f"_risk_amt_{w}_95"),
            )
            for w in ("now", "before")
        ]
        new["churn_rfm_decay_rate"] = level[1] - level[0]
        new["churn_current_to_peak_activity_ratio"] = F.col("_risk_n_now") / (F.col("_peak_quarter") + 1)
        age = F.coalesce(F.col("age").cast("double"), F.col("_age_median"))
        new["_age_quartile"] = rfm.bin_code(age, F.col("_age_edges"), F.col("_age_bins"))
    for i, c in enumerate(clipped):
        x = family_filled(c)
        new[c] = F.when(x.isNotNull(), F.greatest(F.least(x, F.col(f"_hi_{i}")), F.col(f"_lo_{i}")))
    out = out.withColumns(new)
    if "rfm" in relative:
        out = out.withColumn("rfm_segment_encoded", rfm.segment_rank(F.col("rfm_segment")))
    return out.drop(*small)


def _recency_rank(table: DataFrame) -> DataFrame:
    """Percent rank of recency among customers of the same age quartile and reference date."""
    table = materialize(table)
    ranked = average_ranks(table.where(F.col("_age_quartile").isNotNull()).select(
        *KEYS, "_age_quartile", "_risk_recency"), ["ref_date", "_age_quartile"], "_risk_recency", "_rr")
    ranked = ranked.select(
        *KEYS, (F.col("_rr") / F.col("_rr_total")).alias("churn_recency_percentile_in_age_segment")
    )
    return table.join(ranked, KEYS, "left")


def model_matrix(features: DataFrame, drop_like: str = "religion") -> DataFrame:
    """Keys and numeric columns only, without the columns whose name contains ``drop_like``."""
    keep = [
        f.name
        for f in features.schema
        if f.name in (*KEYS, "churn", "split")
        or (f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") and drop_like not in f.name.lower())
    ]
    return features.select(*keep)


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of the label on (cust_id, ref_date)."""
    return features.join(labels.select(*KEYS, "churn"), KEYS, "left")


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
