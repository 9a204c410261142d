"""Calibration of a score stream: isotonic, beta and Platt fits, out of fold, by segment, and the gamma choice.

A calibrator looks at (score, label) only, so rows are first counted per exact score and label. Scores are neither
rounded nor cut off before a fit; only the two logarithms of beta are kept away from 0 and 1. An isotonic fit pools inside
Spark's range partitions first: what reaches the driver are its steps, not the points. The isotonic fits of all folds and segments
are one job, and so is their use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.features.rfm import QUINTILES
from ebbtide.functions.safe import clip
from ebbtide.operators.blend import best_gamma, gamma_sweep
from ebbtide.operators.isotonic import Curves, fit_curves
from ebbtide.operators.metrics import monthly_composite
from ebbtide.operators.ranks import percentiles
from ebbtide.runtime import materialize

KEYS = ["cust_id", "ref_date"]
# Fixed values.
EPS = 1e-6
RAW_SHARE = 0.2
MIN_SEGMENT = 2000
CHOICE_GAMMAS = (0.90, 0.95, 1.00, 1.05, 1.10)
TAIL_GAMMAS = (1.1, 1.2, 1.3)
TAIL_START = 0.10
TAIL_LOSS = 0.002


def points(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Distinct (score, label) pairs with their number of rows as weight; rows that lack either count for nothing."""
    return df.na.drop("any", subset=[score, label]).groupBy(
        *by, F.col(score).cast("double").alias("p"), F.col(label).cast("double").alias("y")
    ).agg(F.count(F.lit(1)).cast("double").alias("w"))


@dataclass
class Calibrator:
    """A fitted calibrator; ``apply`` replaces the score column."""

    method: str
    model: object

    def apply(self, df: DataFrame, score: str = "p", raw_share: float = 0.0) -> DataFrame:
        # A row without a score stays without one.
        kept = df.withColumn("_raw", F.col(score)).withColumn("_p", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
        if self.method == "isotonic":
            out = self.model.transform(kept).withColumn(score, F.col("_iso"))
            drop = ["_iso"]
        else:
            out = self.model.transform(_inputs(kept, self.method)).withColumn(
                score, vector_to_array(F.col("_prob"))[1]
            )
            drop = ["_x", "_prob", "_rawp", "_pred", "_x1", "_x2"]
        cal = F.col(score) if self.method == "isotonic" else clip(F.col(score), EPS, 1.0 - EPS)
        cal = F.when(F.col("_raw").isNotNull(), cal)
        mixed = F.lit(1.0 - raw_share) * cal + F.lit(raw_share) * F.col("_raw") if raw_share else cal
        return out.withColumn(score, mixed).drop(*drop, "_raw", "_p")


def _inputs(df: DataFrame, method: str) -> DataFrame:
    if method == "platt":
        return VectorAssembler(inputCols=["_p"], outputCol="_x").transform(df)
    inner = clip(F.col("_p"), EPS, 1.0 - EPS)
    two = df.withColumns({"_x1": F.ln(inner), "_x2": F.ln(F.lit(1.0) - inner)})
    return VectorAssembler(inputCols=["_x1", "_x2"], outputCol="_x").transform(two)


def fit(df: DataFrame, method: str = "isotonic", score: str = "p", label: str = "y", intercept: bool = True) -> Calibrator:
    """``isotonic`` (clipped at the ends), ``beta`` (logistic on both logs) or ``platt`` (logistic on the score)."""
    pts = points(df, score, label).withColumnRenamed("p", "_p")
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="_p", labelCol="y", weightCol="w", predictionCol="_iso").fit(pts)
        return Calibrator(method, model)
    pts = materialize(pts)
    # The penalty of one unit per coefficient, spread over the rows.
    total = pts.agg(F.sum("w")).first()[0] or 1.0
    lr = LogisticRegression(
        featuresCol="_x", labelCol="y", weightCol="w", probabilityCol="_prob", rawPredictionCol="_rawp",
        predictionCol="_pred", regParam=1.0 / total, standardization=False, maxIter=500, tol=1e-9, fitIntercept=intercept,
    )
    return Calibrator(method, lr.fit(_inputs(pts, method)))


def _mixed(value: Column, score: str, raw_share: float) -> Column:
    """A calibrated score with its share of the raw one; null where there was no score."""
    raw = F.col(score).cast("double")
    cal = F.when(raw.isNotNull(), value)
    return F.lit(1.0 - raw_share) * cal + F.lit(raw_share) * raw if raw_share else cal


def _joined(*parts: Column) -> Column:
    """One text for several values, nulls included; different values give different texts."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]))


def out_of_fold(
    df: DataFrame, fold: str, method: str = "isotonic", score: str = "p", label: str = "y", raw_share: float = 0.0,
    within: Sequence[str] = ()
) -> DataFrame:
    """Each fold calibrated by a fit on the others. ``fold`` is a month or a fold number: few distinct values.

    ``within`` names columns whose groups are fitted apart (isotonic only); a group that is in one fold alone has nothing to be
    fitted on, and its rows get null.
    """
    df = materialize(df)
    names = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    if method == "isotonic":
        # Counts go to the fits of all folds but their own.
        counted = points(df, score, label, [fold, *within]).where(F.col(fold).isNotNull())
        others = F.array_remove(F.array(*[F.lit(n) for n in names]), F.col(fold)) if names else F.array(F.col(fold))
        dealt = counted.withColumn("_for", F.explode(others))
        groups = [F.col(c) for c in within]
        curves = fit_curves(dealt.select(_joined(F.col("_for"), *groups).alias("g"), "p", "y", "w"))
        rows = df.where(F.col(fold).isNotNull())
        return rows.withColumn(score, _mixed(curves.at(_joined(F.col(fold), *groups), F.col(score)), score, raw_share))
    if within:
        raise ValueError("only isotonic fits go by group")
    parts = [
        fit(df.where(F.col(fold) != F.lit(n)), method, score, label).apply(
            df.where(F.col(fold) == F.lit(n)), score, raw_share
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def accept_if_better(raw: DataFrame, calibrated: DataFrame, last_n: int = 6) -> tuple[bool, float, float]:
    """Whether the calibrated stream's monthly composite is at least the raw one's, and both numbers."""
    before = monthly_composite(raw, last_n=last_n).first().composite
    after = monthly_composite(calibrated, last_n=last_n).first().composite
    return bool(after >= before), before, after


def segment_bins(df: DataFrame, value: str, min_rows: int = MIN_SEGMENT, edges: Sequence[float] | None = None) -> tuple[DataFrame, int, list]:
    """Add ``segment``: the quintile bin of ``value`` (left-closed), or one segment when there is too little to cut.

    Returns the inner edges too, so that another frame can be binned the same way.
    """
    if edges is None:
        row = percentiles(df, [], value, QUINTILES, "q", count="n").first()
        distinct = sorted(set(row.q)) if row and row.n is not None and row.n >= min_rows else []
        edges = distinct[1:-1] if len(distinct) >= 3 else []
    bin_no = F.lit(0)
    for e in edges:
        bin_no = bin_no + F.coalesce(F.col(value) >= F.lit(float(e)), F.lit(True)).cast("int")
    return df.withColumn("segment", bin_no), len(edges) + 1, list(edges)


@dataclass
class SegmentCalibrator:
    """One calibrator per large segment, the global one for the others."""

    whole: Calibrator
    own: dict[int, Calibrator]

    def apply(self, df: DataFrame, score: str = "p", raw_share: float = RAW_SHARE) -> DataFrame:
        rest = ~F.col("segment").isin(*self.own) if self.own else F.lit(True)
        parts = [self.whole.apply(df.where(rest), score, raw_share)]
        parts += [c.apply(df.where(F.col("segment") == s), score, raw_share) for s, c in self.own.items()]
        return reduce(DataFrame.unionByName, parts)


WHOLE = "whole"


@dataclass
class SegmentCurves:
    """The isotonic curve of each large segment, under its number, and the global one for the others."""

    curves: Curves

    @property
    def own(self) -> list[str]:
        """The segments that have a curve of their own."""
        return [g for g in self.curves.places if g != WHOLE]

    def apply(self, df: DataFrame, score: str = "p", raw_share: float = RAW_SHARE) -> DataFrame:
        own, name = self.own, F.col("segment").cast("string")
        group = F.when(name.isin(*own), name).otherwise(F.lit(WHOLE)) if own else F.lit(WHOLE)
        return df.withColumn(score, _mixed(self.curves.at(group, F.col(score)), score, raw_share))


def fit_segments(
    df: DataFrame, segments: int, method: str = "isotonic", min_rows: int = MIN_SEGMENT, score: str = "p", label: str = "y"
) -> SegmentCalibrator | SegmentCurves:
    sizes = {r.segment: r.n for r in df.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [s for s in range(segments) if sizes.get(s, 0) >= min_rows]
    if method == "isotonic":
        own = F.when(F.col("segment").isin(*large), F.col("segment").cast("string")) if large else F.lit(None).cast("string")
        dealt = points(df, score, label, ["segment"]).withColumn("g", F.explode(F.array(own, F.lit(WHOLE))))
        return SegmentCurves(fit_curves(dealt))
    return SegmentCalibrator(
        fit(df, method, score, label), {s: fit(df.where(F.col("segment") == s), method, score, label) for s in large}
    )


def power(p: Column, gamma: float) -> Column:
    return clip(F.pow(p, F.lit(float(gamma))), EPS, 1.0 - EPS)


@dataclass
class Choice:
    method: str
    gamma: float
    composite: float
    oof: DataFrame
    test: DataFrame | None


def choose(
    oof: DataFrame, test: DataFrame | None = None, gammas: Sequence[float] = CHOICE_GAMMAS, raw_share: float = RAW_SHARE,
    last_n: int = 6
) -> Choice:
    """Isotonic or beta by monthly composite (isotonic on ties), then the best gamma (the first on ties).

    When even the lowest test score stays above a tenth, a larger gamma is taken if it costs next to nothing.
    """
    oof = materialize(oof)
    made, scores = {}, {}
    for m in ("isotonic", "beta"):
        c = fit(oof, m)
        made[m] = (c, materialize(c.apply(oof, raw_share=raw_share)))
        scores[m] = monthly_composite(made[m][1], last_n=last_n).first().composite
    method = "isotonic" if scores["isotonic"] >= scores["beta"] else "beta"
    calibrator, stream = made[method]
    best = best_gamma(gamma_sweep(stream, gammas, last_n=last_n)).first()
    gamma, composite = best.gamma, best.composite
    scored_test = None
    if test is not None:
        scored_test = materialize(calibrator.apply(test, raw_share=raw_share))
        lowest = scored_test.agg(F.min(power(F.col("p"), gamma))).first()[0]
        if lowest is not None and lowest > TAIL_START:
            tail = gamma_sweep(stream, TAIL_GAMMAS, last_n=last_n).orderBy("candidate").collect()
            gamma = next((r.gamma for r in tail if r.composite >= composite - TAIL_LOSS), gamma)
        scored_test = scored_test.withColumn("p", power(F.col("p"), gamma))
    return Choice(method, gamma, composite, stream.withColumn("p", power(F.col("p"), gamma)), scored_test)


def recalibrate(
    oof: DataFrame, test: DataFrame, method: str = "isotonic", gamma: float | None = None, intercept: bool = True,
    raw_share: float = 0.0
) -> tuple[DataFrame, DataFrame, float]:
    """A stored stream through one calibrator and one gamma (searched when not given)."""
    c = fit(oof, method, intercept=intercept)
    stream = materialize(c.apply(oof, raw_share=raw_share))
    if gamma is None:
        gamma = best_gamma(gamma_sweep(stream)).first().gamma
    adjust = power(F.col("p"), gamma)
    return stream.withColumn("p", adjust), c.apply(test, raw_share=raw_share).withColumn("p", adjust), gamma
