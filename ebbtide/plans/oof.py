"""Out-of-fold model scores.

Every fit is a distributed Spark ML fit. Rows are assembled once and written out; each fold then reads the months it
needs. Only fold names, models and importances live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.periods import month_start
from ebbtide.functions.safe import sigmoid
from ebbtide.operators import folds as fold_ops
from ebbtide.operators.metrics import flip_guard, monthly_composite
from ebbtide.operators.ranks import row_numbers
from ebbtide.plans.newton import NewtonBooster, fit_together
from ebbtide.runtime import materialize

KEYS = ["cust_id", "ref_date"]
# Fixed values.
SEEDS = (1, 11, 111, 1111, 11111)
POSITIVE_WEIGHT = 8.0


@dataclass(frozen=True)
class Learner:
    """What to fit. ``kind``: gbt, newton, forest, logistic or ridge; ``params`` go to the estimator."""

    kind: str = "gbt"
    params: dict = field(default_factory=dict)
    early_stop: bool = False

    @property
    def draws_by_place(self) -> bool:
        """Whether the rows of a tree are drawn by their place; the others take all rows or draw them by key."""
        return self.kind in ("gbt", "forest")

    def estimator(self, seed: int):
        common = {"featuresCol": "features", "labelCol": "y", "weightCol": "w"}
        if self.kind == "gbt":
            base = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8,
                    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": seed}
            stop = {"validationIndicatorCol": "is_valid"} if self.early_stop else {}
            return GBTClassifier(**common, **{**base, **stop, **self.params})
        if self.kind == "newton":
            return NewtonBooster(**{"seed": seed, "patience": 10 if self.early_stop else 0, **self.params})
        if self.kind == "forest":
            base = {"numTrees": 50, "maxDepth": 8, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "seed": seed}
            return RandomForestClassifier(**common, **{**base, **self.params})
        scaled = {**common, "featuresCol": "scaled"}
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        if self.kind == "logistic":
            base = {"maxIter": 200, "regParam": 0.0, "standardization": False}
            return Pipeline(stages=[scaler, LogisticRegression(**scaled, **{**base, **self.params})])
        if self.kind == "ridge":
            base = {"elasticNetParam": 0.0, "regParam": 0.1, "standardization": False}
            return Pipeline(stages=[scaler, LinearRegression(**scaled, **{**base, **self.params})])
        raise ValueError(self.kind)

    def for_rows(self, train: DataFrame) -> Learner:
        """The same with a parameter ``c``, an inverse penalty on the sum of losses, turned into Spark's penalty on their mean."""
        if "c" not in self.params:
            return self
        held = train.where("NOT is_valid") if "is_valid" in train.columns else train
        total = held.where("y IS NOT NULL").agg(F.sum("w").alias("w")).first().w or 1.0
        rest = {k: v for k, v in self.params.items() if k != "c"}
        return replace(self, params={**rest, "regParam": 1.0 / (self.params["c"] * total)})

    def score(self, transformed: DataFrame) -> Column:
        if self.kind == "ridge":
            return sigmoid(F.col("prediction"))
        if self.kind == "newton":
            return F.col("score")
        return vector_to_array(F.col("probability"))[1]


@dataclass(frozen=True)
class Split:
    """One fold: its name and the conditions that select training and validation rows."""

    name: str
    train: Column
    valid: Column


@dataclass
class OofResult:
    """``oof`` (fold, cust_id, ref_date, y, p), the models as (fold, seed, model), and the feature names."""

    oof: DataFrame
    models: list
    features: list[str]
    learner: Learner

    def composite(self, last_n: int = 6) -> float:
        return self.oof.transform(monthly_composite, last_n=last_n).first().composite

    def importance(self) -> DataFrame:
        """(feature, fold, gain): model importances, averaged over seeds."""
        spark, rows = self.oof.sparkSession, []
        for fold, seed, model in self.models:
            gains = getattr(model, "featureImportances", None)
            if gains is None:
                gains = [abs(c) for c in model.stages[-1].coefficients]
            rows += [(f, fold, seed, float(g)) for f, g in zip(self.features, gains)]
        long = spark.createDataFrame(rows, "feature string, fold string, seed int, gain double")
        return long.groupBy("feature", "fold").agg(F.avg("gain").alias("gain"))

    def predict(self, matrix: DataFrame) -> DataFrame:
        """Mean score of all models for new rows: (cust_id, ref_date, p)."""
        rows = assemble(matrix, self.features, label=None)
        return mean_score(rows, [m for _, _, m in self.models], self.learner)


def assemble(
    matrix: DataFrame, features: Sequence[str], label: str | None = "churn", weight: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Keys, month, label, weight, the columns to keep and the feature vector."""
    w = fold_ops.clean_weight(F.col(weight)) if weight else F.lit(1.0)
    y = F.col(label).cast("double") if label else F.lit(None).cast("double")
    slim = matrix.select(
        *KEYS, month_start(F.col("ref_date")).alias("month"), y.alias("y"), w.alias("w"), *keep,
        *[F.col(f).cast("double").alias(f"x_{i}") for i, f in enumerate(features)],
    )
    names = [f"x_{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(slim).drop(*names)


def mean_score(rows: DataFrame, models: Sequence, learner: Learner) -> DataFrame:
    """Mean of the models' scores per row, in one pass over the rows."""
    out = rows.select(*KEYS, "features")
    names = []
    for i, m in enumerate(models):
        got = m.transform(out)
        out = got.select(*KEYS, "features", *names, learner.score(got).alias(f"p{i}"))
        names.append(f"p{i}")
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return out.select(*KEYS, (total / len(names)).alias("p"))


def month_splits(rows: DataFrame, last_n: int = 6, gap: int = 1) -> list[Split]:
    """Month folds as conditions on ``month``."""
    table = fold_ops.month_folds(rows, last_n, gap).collect()
    out = []
    for fold in sorted({r.fold for r in table}):
        side = {role: [F.lit(r.month) for r in table if r.fold == fold and r.role == role] for role in ("train", "valid")}
        out.append(Split(fold.strftime("%Y-%m"), F.col("month").isin(*side["train"]), F.col("month").isin(*side["valid"])))
    return out


def table_splits(folds: DataFrame) -> list[Split]:
    """A fold table (fold, role, month) as conditions."""
    table = folds.collect()
    out = []
    for fold in sorted({r.fold for r in table}):
        side = {role: [F.lit(r.month) for r in table if r.fold == fold and r.role == role] for role in ("train", "valid")}
        out.append(Split(str(fold), F.col("month").isin(*side["train"]), F.col("month").isin(*side["valid"])))
    return out


def column_splits(column: str, k: int, forward: bool = False) -> list[Split]:
    """Folds by a fold column; ``forward`` trains on smaller values only."""
    c = F.col(column)
    if forward:
        return [Split(str(i), c < i, c == i) for i in range(1, k + 1)]
    return [Split(str(i), c != i, c == i) for i in range(k)]


def _with_decay(train: DataFrame, lam: float | None) -> DataFrame:
    """Weight falling with the distance to the fold's last training month, mean one."""
    if not lam or lam <= 0:
        return train
    counts = train.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("month")).scalar()
    gap = (F.year(last) - F.year("month")) * 12 + F.month(last) - F.month("month")
    raw = counts.withColumn("d", F.exp(F.lit(-float(lam)) * gap))
    mean = raw.agg(F.sum(F.col("d") * F.col("n")) / F.sum("n")).scalar()
    table = materialize(raw.select("month", (F.col("d") / mean).alias("decay")))
    return train.join(table, "month").withColumn("w", F.col("w") * F.col("decay")).drop("decay")


def _in_fixed_order(rows: DataFrame) -> DataFrame:
    """Rows placed by key and sorted inside their partition: bagging then draws the same rows for the same seed."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def _weighted(rows: DataFrame, split: Split, lam: float | None, positive_weight: float) -> DataFrame:
    """A fold's training rows with their weights."""
    train = _with_decay(rows.where(split.train), lam)
    if positive_weight == 1.0:
        return train
    return train.withColumn("w", F.when(F.col("y") == 1, F.col("w") * positive_weight).otherwise(F.col("w")))


def _guarded(scored: DataFrame, by: Sequence[str], average: str) -> DataFrame:
    """(``by``, keys, y, p): scores guarded against a flip per (``by``, seed) and averaged over seeds, written."""
    scored = flip_guard(materialize(scored), [*by, "seed"])
    if average == "rank":
        placed = row_numbers(scored, [*by, "seed"], [F.col("p"), *map(F.col, KEYS)], "_rn")
        scored = placed.withColumn("p", (F.col("_rn") - 1) / F.greatest(F.col("_rn_total") - 1, F.lit(1)))
    return materialize(scored.groupBy(*by, *KEYS, "y").agg(F.avg("p").alias("p")))


def fit_folds(
    rows: DataFrame,
    features: Sequence[str],
    splits: Sequence[Split],
    learner: Learner,
    seeds: Sequence[int] = (1,),
    lam: float | None = None,
    positive_weight: float = 1.0,
    average: str = "mean",
    parallel: int = 2,
) -> OofResult:
    """Fit every (fold, seed), guard each against a flipped score, average over seeds.

    ``rows`` are read again for every fold and pass: give a written table.
    ``average='rank'`` averages the scaled ordinal ranks inside a fold instead of the scores.
    """

    def one(split: Split) -> list:
        train = _weighted(rows, split, lam, positive_weight)
        valid = rows.where(split.valid)
        if learner.early_stop:
            train = train.withColumn("is_valid", F.lit(False)).unionByName(valid.withColumn("is_valid", F.lit(True)))
        if learner.draws_by_place:
            train = _in_fixed_order(materialize(train))
        mine = learner.for_rows(train)
        return [(split.name, s, mine.estimator(s).fit(train), valid) for s in seeds]

    if parallel > 1 and len(splits) > 1:
        with ThreadPoolExecutor(parallel) as pool:
            fitted = [x for r in pool.map(inheritable_thread_target(rows.sparkSession)(one), splits) for x in r]
    else:
        fitted = [x for s in splits for x in one(s)]
    parts = []
    for fold, seed, model, valid in fitted:
        got = model.transform(valid)
        parts.append(got.select(
            F.lit(fold).alias("fold"), F.lit(seed).alias("seed"), *KEYS, F.col("y").cast("int").alias("y"),
            learner.score(got).alias("p")))
    oof = _guarded(reduce(DataFrame.unionByName, parts), ["fold"], average)
    return OofResult(oof, [(f, s, m) for f, s, m, _ in fitted], list(features), learner)


def train_oof(
    matrix: DataFrame,
    features: Sequence[str],
    learner: Learner = Learner(),
    label: str = "churn",
    last_n: int = 6,
    gap: int = 1,
    lam: float | None = 0.2,
    seeds: Sequence[int] = SEEDS,
    weight: str | None = None,
    **kw,
) -> OofResult:
    """Month folds with a gap, time-decay weights, one fit per seed."""
    rows = materialize(assemble(matrix, features, label, weight))
    return fit_folds(rows, features, month_splits(rows, last_n, gap), learner, seeds, lam, **kw)


@dataclass
class TwoStage:
    stage_a: OofResult
    stage_b: OofResult

    def predict(self, matrix: DataFrame) -> DataFrame:
        """Mean of the first stage, its ranks among the scored rows, then the mean of the second stage."""
        wide = _add_stage(matrix, materialize(self.stage_a.predict(matrix)))
        return self.stage_b.predict(wide)


def _add_stage(matrix: DataFrame, scores: DataFrame) -> DataFrame:
    """Matrix plus pA, its rank scaled to [0, 1], and rank / n. Rows never scored keep zeros."""
    from ebbtide.operators.ranks import average_ranks

    ranked = average_ranks(scores.select(*KEYS, "p"), [], "p", "r")
    extra = ranked.select(
        *KEYS, F.col("p").alias("pA"), ((F.col("r") - 1) / F.greatest(F.col("r_total") - 1, F.lit(1))).alias("rank_pA"),
        (F.col("r") / F.col("r_total")).alias("rank_boost"),
    )
    return matrix.join(extra, KEYS, "left").fillna(0.0, ["pA", "rank_pA", "rank_boost"])


def train_two_stage(
    matrix: DataFrame,
    features: Sequence[str],
    learner_a: Learner = Learner(params={"maxDepth": 6}),
    learner_b: Learner = Learner(),
    label: str = "churn",
    last_n: int = 6,
    gap: int = 1,
    lam: float | None = 0.2,
    **kw,
) -> TwoStage:
    """A recall-leaning first stage, and a second stage that sees its out-of-fold score and rank."""
    a = train_oof(matrix, features, learner_a, label, last_n, gap, lam, (42,), positive_weight=POSITIVE_WEIGHT, **kw)
    wide = _add_stage(matrix, a.oof)
    b = train_oof(wide, [*features, "pA", "rank_pA", "rank_boost"], learner_b, label, last_n, gap, lam, (42,), **kw)
    return TwoStage(a, b)


def pseudo_labels(scored: DataFrame, top: float = 0.025, bottom: float = 0.40, score: str = "p") -> DataFrame:
    """Lowest-scored share as 0 and highest-scored share as 1 (at least one row each), from exact row numbers.

    Rows without a score get no label.
    """
    placed = row_numbers(scored.na.drop("any", subset=[score]), [], [F.col(score), *map(F.col, KEYS)], "_rn")
    n = F.col("_rn_total")
    low = F.greatest(F.lit(1), F.rint(F.lit(bottom) * n))
    high = F.greatest(F.lit(1), F.rint(F.lit(top) * n))
    picked = F.when(F.col("_rn") <= low, F.lit(0)).when(F.col("_rn") > n - high, F.lit(1))
    return placed.withColumn("churn", picked).where("churn is not null").drop("_rn", "_rn_total")


def pseudo_label_round(
    train: DataFrame, test: DataFrame, features: Sequence[str], learner: Learner, gain: float = 0.003, last_n: int = 6,
    seeds: Sequence[int] = (1,), **kw
) -> DataFrame:
    """One row: composite before and after training with confident test rows, and whether to accept.

    Both are measured on the original rows only.
    """
    base = train_oof(train, features, learner, last_n=last_n, seeds=seeds, **kw)
    chosen = pseudo_labels(base.predict(test)).select(*KEYS, "churn")
    extra = test.drop("churn").join(materialize(chosen), KEYS)
    both = train.select(*KEYS, "churn", *features).unionByName(extra.select(*KEYS, "churn", *features))
    again = train_oof(both, features, learner, last_n=last_n, seeds=seeds, **kw)
    original = again.oof.join(train.select(*KEYS), KEYS, "left_semi")
    before = base.composite(last_n)
    after = original.transform(monthly_composite, last_n=last_n).first().composite
    # A month may lose its original rows altogether; then there is no score to accept.
    after = float("nan") if after is None else after
    return train.sparkSession.createDataFrame(
        [(before, after, bool(after - before >= gain))], "before double, after double, accepted boolean"
    )


def search(
    matrix: DataFrame, features: Sequence[str], candidates: Sequence[Learner], last_n: int = 6, gap: int = 1,
    seeds: Sequence[int] = (1,), **kw
) -> DataFrame:
    """(candidate, params, composite), best first, first candidate on ties. Rows are assembled once."""
    rows = materialize(assemble(matrix, features))
    splits = month_splits(rows, last_n, gap)
    out = []
    for i, c in enumerate(candidates):
        got = fit_folds(rows, features, splits, c, seeds, 0.2, **kw)
        out.append((i, f"{c.kind} {sorted(c.params.items())}", got.composite(last_n)))
    table = matrix.sparkSession.createDataFrame(out, "candidate int, params string, composite double")
    return table.orderBy(F.desc_nulls_last(F.round("composite", 9)), "candidate")


def stops(means: dict[int, float], rung_ends: bool, eta: int = 2) -> dict[int, str]:
    """Which candidates stop, and why, by their mean over the folds so far; a mean that is missing counts as the lowest.

    After each fold those below the median stop; where a rung ends, all but the best 1 / ``eta`` do. Ties go to the first.
    """
    low = {i: -np.inf if m is None or np.isnan(m) else round(m, 9) for i, m in means.items()}
    order = sorted(low, key=lambda i: (-low[i], i))
    middle = low[order[(len(order) - 1) // 2]]
    out = {i: "median" for i in order if low[i] < middle}
    if rung_ends:
        out |= {i: "halving" for i in order[-(-len(order) // eta):] if i not in out}
    return out


def _fold_composites(
    rows: DataFrame, features: Sequence[str], split: Split, candidates: dict[int, Learner], seeds: Sequence[int], lam: float | None,
    parallel: int, positive_weight: float = 1.0, average: str = "mean", **kw
) -> dict[int, float | None]:
    """Composite of each candidate on one fold, as :func:`fit_folds` and its last month give it.

    Second-order trees without early stopping are grown together where their bins agree: weights, percentiles and binned rows of the
    fold are made once for all of them, a level of all trees is one pass, and all are scored in one job.
    """
    shared: dict[tuple, list[int]] = {}
    for i, c in candidates.items():
        if c.kind == "newton" and not (own := c.estimator(seeds[0])).patience:
            shared.setdefault((own.bins, tuple(own.keys)), []).append(i)

    def alone(i: int) -> float | None:
        return fit_folds(rows, features, [split], candidates[i], seeds, lam, positive_weight, average, **kw).composite(1)

    rest = sorted(candidates.keys() - {i for group in shared.values() for i in group})
    out: dict[int, float | None] = dict.fromkeys(candidates)
    with ThreadPoolExecutor(parallel) as pool:
        out |= dict(zip(rest, pool.map(inheritable_thread_target(rows.sparkSession)(alone), rest)))
    if not shared:
        return out
    valid, parts = rows.where(split.valid), []
    train = _weighted(rows, split, lam, positive_weight)
    for group in shared.values():
        tries = [(i, seed) for i in group for seed in seeds]
        scored = valid
        for n, model in enumerate(fit_together([candidates[i].estimator(seed) for i, seed in tries], train)):
            scored = model.transform(scored).withColumnRenamed("score", f"p{n}")
        each = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(seed).alias("seed"), F.col(f"p{n}").alias("p")) for n, (i, seed) in enumerate(tries)])
        parts.append(scored.select(*KEYS, F.col("y").cast("int").alias("y"), F.inline(each)))
    oof = _guarded(reduce(DataFrame.unionByName, parts), ["candidate"], average)
    return out | {r.candidate: r.composite for r in monthly_composite(oof, ["candidate"], last_n=1).collect()}


def halving_search(
    matrix: DataFrame, features: Sequence[str], candidates: Sequence[Learner], last_n: int = 6, gap: int = 1, seeds: Sequence[int] = (1,),
    eta: int = 2, parallel: int = 2, **kw
) -> DataFrame:
    """(candidate, params, fold, composite, mean, state): the search of :func:`search` with candidates that fall behind stopped early.

    Rungs take one month's fold, then two, four and so on; all candidates still in are fitted side by side, and share what the fold
    gives all of them (see :func:`_fold_composites`). ``state`` is kept,
    median or halving (see :func:`stops`) or finished, for those that were fitted on all folds.
    """
    rows = materialize(assemble(matrix, features))
    splits = month_splits(rows, last_n, gap)
    scores: dict[int, list] = {i: [] for i in range(len(candidates))}
    out, rung, left = [], 1, 1
    alive = list(scores)
    for n, split in enumerate(splits):
        for i, g in _fold_composites(rows, features, split, {i: candidates[i] for i in alive}, seeds, 0.2, parallel, **kw).items():
            scores[i].append(g)
        left -= 1
        last = n == len(splits) - 1
        means = {i: float(np.mean([np.nan if s is None else s for s in scores[i]])) for i in alive}
        out_now = {} if last else stops(means, left == 0, eta)
        for i in alive:
            state = "finished" if last else out_now.get(i, "kept")
            out.append((i, f"{candidates[i].kind} {sorted(candidates[i].params.items())}", split.name, scores[i][-1], means[i], state))
        alive = [i for i in alive if i not in out_now]
        if left == 0:
            rung *= 2
            left = rung
    return matrix.sparkSession.createDataFrame(
        out, "candidate int, params string, fold string, composite double, mean double, state string")


def mini_evaluation(
    matrix: DataFrame, features: Sequence[str], learner: Learner = Learner(), sample: int = 20_000, seed: int = 42
) -> DataFrame:
    """Last six months: four train (on a row sample), two validate, one fit, one metric row."""
    from ebbtide.operators.metrics import last_months, ranking_metrics
    from ebbtide.operators.quality import sample_rows

    recent = materialize(last_months(matrix, 6))
    months = sorted(r.month for r in recent.select("month").distinct().collect())
    valid_months = [F.lit(m) for m in months[-2:]]
    rest = recent.where(~F.col("month").isin(*valid_months)).drop("month")
    train = sample_rows(rest, KEYS, sample, seed)
    valid = recent.where(F.col("month").isin(*valid_months)).drop("month")
    model = learner.estimator(seed).fit(assemble(train, features))
    got = model.transform(assemble(valid, features))
    scored = got.select(*KEYS, F.col("y").cast("int").alias("y"), learner.score(got).alias("p"))
    return ranking_metrics(flip_guard(materialize(scored)))


def cross_period(matrix: DataFrame, features: Sequence[str], learner: Learner, n_splits: int = 5, test_months: int = 2) -> DataFrame:
    """(fold, auc) over rolling blocks, with the coefficient of variation and the verdict (above 5 % is unstable)."""
    from ebbtide.operators.metrics import auc

    rows = materialize(assemble(matrix, features))
    splits = table_splits(fold_ops.rolling_folds(rows, n_splits, test_months, 1))
    aucs = auc(fit_folds(rows, features, splits, learner).oof, ["fold"])
    cv = aucs.agg(F.stddev_pop("auc") / F.avg("auc"))
    return aucs.select("fold", "auc", cv.scalar().alias("cv")).withColumn("stable", F.col("cv") <= 0.05)


def steady_features(
    matrix: DataFrame, features: Sequence[str], learner: Learner, n_splits: int = 5, test_months: int = 2, **kw
) -> DataFrame:
    """Stable-feature selection on importances of rolling splits."""
    from ebbtide.operators.importance import stable_features

    rows = materialize(assemble(matrix, features))
    splits = table_splits(fold_ops.rolling_folds(rows, n_splits, test_months, 1))
    gains = fit_folds(rows, features, splits, learner).importance()
    return stable_features(gains.withColumnRenamed("fold", "split"), **kw)


def with_params(learner: Learner, **params) -> Learner:
    return replace(learner, params={**learner.params, **params})
