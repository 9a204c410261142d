"""Variants of a blend: templates x first-stage share x rank mode x calibration x gamma, scored and thinned out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.blend import rank_space, sweep, weighted
from ebbtide.operators.metrics import auc, monthly_composite, ranking_metrics
from ebbtide.plans import calibration
from ebbtide.runtime import materialize

KEYS = ["cust_id", "ref_date"]
# Fixed values.
SHARES = (0.0, 0.05, 0.10, 0.20, 0.30)
GAMMAS = (0.90, 0.95, 1.00, 1.05, 1.10)
PER_SIGNATURE = 4
TOP_K = 25


@dataclass(frozen=True)
class Blend:
    """One blend before calibration: normalised weights, the first-stage share, and the space it is mixed in."""

    weights: tuple[tuple[str, float], ...]
    share: float
    ranks: bool

    @property
    def signature(self) -> str:
        return ",".join(f"{m}:{w:.4f}" for m, w in sorted(self.weights))


def blends(templates: Sequence[dict[str, float]], first_stage: str | None, shares: Sequence[float] = SHARES,
           rank_modes: Sequence[bool] = (False, True)) -> list[Blend]:
    out = {}
    for t, share, ranks in product(templates, shares, rank_modes):
        share = share if first_stage else 0.0
        w = {m: x * (1.0 - share) for m, x in t.items()}
        if share > 0:
            w[first_stage] = share
        total = sum(w.values())
        b = Blend(tuple(sorted((m, round(x / total, 6)) for m, x in w.items())), share, ranks)
        out[b] = None
    return list(out)


def build(
    oof: DataFrame,
    templates: Sequence[dict[str, float]],
    first_stage: str | None = None,
    shares: Sequence[float] = SHARES,
    rank_modes: Sequence[bool] = (False, True),
    methods: Sequence[str] = ("isotonic", "beta"),
    gammas: Sequence[float] = GAMMAS,
    per_signature: int = PER_SIGNATURE,
    top_k: int = TOP_K,
    last_n: int = 6,
) -> DataFrame:
    """(id, signature, weights, share, ranks, calibration, gamma, composite) of the kept variants, best first.

    ``oof`` is wide: keys, y, one column per stream. Each (blend, calibration) is fitted once; all gammas of all
    variants are then swept in one job, on counts.
    """
    streams = [c for c in oof.columns if c not in (*KEYS, "y")]
    oof = materialize(oof)
    spaces = {False: oof}
    if True in rank_modes:
        spaces[True] = materialize(rank_space(oof, streams))
    todo = blends(templates, first_stage, shares, rank_modes)
    stacked, rows = None, []
    for i, b in enumerate(todo):
        p = spaces[b.ranks].select(*KEYS, "y", weighted(dict(b.weights)).alias("p"))
        low = auc(p).first().auc
        if low is not None and low < 0.5:
            p = p.withColumn("p", F.lit(1.0) - F.col("p"))
        for m in methods:
            c = calibration.fit(p, m).apply(p, raw_share=calibration.RAW_SHARE)
            part = c.select(*KEYS, "y", "p", F.lit(i).alias("blend"), F.lit(m).alias("calibration"))
            stacked = part if stacked is None else stacked.unionByName(part)
        rows.append((i, b.signature, dict(b.weights), b.share, b.ranks))
    def power(p: Column, g: Column) -> Column:
        return calibration.clip(F.pow(p, g), calibration.EPS, 1.0 - calibration.EPS)

    scored = sweep(materialize(stacked), ["blend", "calibration"], gammas, power, last_n).drop("candidate")
    names = oof.sparkSession.createDataFrame(
        rows, "blend int, signature string, weights map<string,double>, share double, ranks boolean"
    )
    return thin(scored.join(names, "blend"), per_signature, top_k)


def thin(variants: DataFrame, per_signature: int = PER_SIGNATURE, top_k: int = TOP_K) -> DataFrame:
    """Best variant per (calibration, gamma, share, weights, ranks), at most ``per_signature`` per weight
    signature, the best ``top_k`` overall. One row per variant, so the windows are small."""
    best = F.desc_nulls_last(F.round("composite", 9))
    key = Window.partitionBy("calibration", "gamma", "share", "signature", "ranks").orderBy(best, "blend")
    sig = Window.partitionBy("signature").orderBy(best, "calibration", "gamma", "blend")
    kept = variants.withColumn("_k", F.row_number().over(key)).where("_k = 1")
    kept = kept.withColumn("_s", F.row_number().over(sig)).where(F.col("_s") <= per_signature)
    top = kept.orderBy(best, "signature", "calibration", "gamma", "blend").limit(top_k)
    return top.select("signature", "weights", "share", "ranks", "calibration", "gamma", "composite")


def rescore(oof: DataFrame, variants: DataFrame, last_n: int = 6) -> DataFrame:
    """(id, month, recall, composite) of stored variants: blend from the JSON weights, calibrate, score each month.

    ``variants`` has (id, weights as JSON text, calibration, gamma) and is a short list.
    """
    parsed = variants.withColumn("w", F.from_json("weights", "map<string,double>")).collect()
    oof, stacked = materialize(oof), None
    for v in parsed:
        p = oof.select(*KEYS, "y", weighted(v.w, [c for c in oof.columns if c in v.w]).alias("p"))
        if v.calibration != "none":
            p = calibration.fit(p, v.calibration).apply(p, raw_share=calibration.RAW_SHARE)
        p = p.withColumn("p", calibration.power(F.col("p"), v.gamma))
        part = p.select(*KEYS, "y", "p", F.lit(v.id).alias("id"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = materialize(stacked)
    recall = ranking_metrics(stacked.withColumn("month", F.trunc("ref_date", "MM")), ["id", "month"]).select("id", "month", "recall")
    whole = materialize(monthly_composite(stacked, ["id"], last_n).select("id", "composite"))
    return recall.join(whole, "id")


def emit(test: DataFrame, oof: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, cust_id, ref_date, churn): the scoring cohort under each kept variant, mixed in the variant's own space."""
    streams = [c for c in oof.columns if c not in (*KEYS, "y")]
    oof, test, out = materialize(oof), materialize(test), None
    spaces = {False: (oof, test)}
    picked = variants.collect()
    if any(v.ranks for v in picked):
        spaces[True] = (materialize(rank_space(oof, streams)), materialize(rank_space(test, streams)))
    for i, v in enumerate(picked, 1):
        side_o, side_t = spaces[v.ranks]
        mix = weighted(v.weights).alias("p")
        a, b = side_o.select(*KEYS, "y", mix), side_t.select(*KEYS, mix)
        low = auc(a).first().auc
        if low is not None and low < 0.5:
            a, b = (x.withColumn("p", F.lit(1.0) - F.col("p")) for x in (a, b))
        got = calibration.fit(a, v.calibration).apply(b, raw_share=calibration.RAW_SHARE)
        part = got.select(F.lit(i).alias("id"), *KEYS, calibration.power(F.col("p"), v.gamma).alias("churn"))
        out = part if out is None else out.unionByName(part)
    return out
