"""Train/test drift: a classifier tells the cohorts apart, and features that let it are dropped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.safe import clip
from ebbtide.operators import folds as fold_ops
from ebbtide.operators.metrics import auc
from ebbtide.operators.quality import domain_weight, odds, with_split
from ebbtide.plans.oof import KEYS, Learner, OofResult, assemble, column_splits, fit_folds, train_oof
from ebbtide.runtime import materialize

# Fixed values.
HOLDOUT = 5


@dataclass
class Domain:
    """AUC of telling the cohorts apart (0.5: no drift) and the importance of each feature for it."""

    auc: float
    importance: DataFrame
    result: OofResult

    def ranked(self) -> list[str]:
        rows = self.importance.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(F.desc("gain"), "feature")
        return [r.feature for r in rows.collect()]


def domain_rows(train: DataFrame, test: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Both sides with ``domain`` and ``fold``, written: fits and importances read them many times."""
    both = with_split(train.select(*KEYS, *features), test.select(*KEYS, *features))
    return materialize(fold_ops.stratified_folds(both, "domain", KEYS, k, seed))


def domain_classifier(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    learner: Learner = Learner(),
    k: int = 5,
    holdout: bool = False,
    seed: int = 42,
) -> Domain:
    """Cross-validated over ``k`` stratified folds, or one stratified hold-out of a fifth."""
    folded = domain_rows(train, test, features, HOLDOUT if holdout else k, seed)
    rows = materialize(assemble(folded.na.drop("any", subset=KEYS), features, "domain", keep=["fold"]))
    splits = column_splits("fold", HOLDOUT if holdout else k)[: 1 if holdout else None]
    result = fit_folds(rows, features, splits, learner, (seed,))
    # Folds are scored apart: their models are not on one scale.
    mean = auc(result.oof, ["fold"]).agg(F.avg("auc").alias("auc")).first().auc
    return Domain(float(mean), result.importance(), result)


def domain_weights(train: DataFrame, test: DataFrame, features: Sequence[str], kind: str = "odds", seed: int = 42) -> DataFrame:
    """(cust_id, ref_date, w) for training rows, larger for rows that look like the scoring cohort."""
    learner = Learner("logistic")
    rows = materialize(assemble(with_split(train.select(*KEYS, *features), test.select(*KEYS, *features)), features, "domain"))
    model = learner.estimator(seed).fit(rows)
    got = model.transform(rows.where("y = 0"))
    scored = materialize(got.select(*KEYS, learner.score(got).alias("p")))
    if kind != "odds":
        return scored.select(*KEYS, domain_weight(F.col("p"), kind).alias("w"))
    mean = scored.agg(F.avg(odds(F.col("p")))).scalar()
    return scored.select(*KEYS, clip(odds(F.col("p")) / mean, 0.5, 2.0).alias("w"))


def drop_drifting(
    train: DataFrame, test: DataFrame, features: Sequence[str], k: int = 40, learner: Learner = Learner()
) -> tuple[list[str], DataFrame]:
    """Drop the ``k`` most drifting features at once: what stays, and a report with the AUC before and after."""
    before = domain_classifier(train, test, features, learner)
    dropped = before.ranked()[: min(k, len(features) - 1)]
    kept = [f for f in features if f not in set(dropped)]
    after = domain_classifier(train, test, kept, learner)
    report = train.sparkSession.createDataFrame(
        [(before.auc, after.auc, len(dropped), dropped)], "auc_before double, auc_after double, n int, dropped array<string>"
    )
    return kept, report


def iterative_filter(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    step: int = 5,
    target: float = 0.75,
    max_loss: float = 0.02,
    learner: Learner = Learner(),
    last_n: int = 6,
    seeds: Sequence[int] = (1,),
    max_steps: int | None = None,
) -> tuple[list[str], DataFrame]:
    """Drop the most drifting features step by step until the cohorts look alike.

    A step is kept when the monthly composite falls by no more than ``max_loss``; otherwise half as many features are
    tried. Every fit is a Spark job; the loop only decides.
    """
    keep = list(features)
    best = train_oof(train, keep, learner, last_n=last_n, seeds=seeds).composite(last_n)
    history, round_no = [], 0
    while max_steps is None or round_no < max_steps:
        round_no += 1
        domain = domain_classifier(train, test, keep, learner, holdout=True)
        dropped: list[str] = []
        if domain.auc > target and len(keep) > 1:
            order, k = domain.ranked(), max(1, min(step, len(keep) - 1))
            while k >= 1 and not dropped:
                trial = [f for f in keep if f not in set(order[:k])]
                score = train_oof(train, trial, learner, last_n=last_n, seeds=seeds).composite(last_n)
                if score - best >= -max_loss:
                    keep, best, dropped = trial, score, order[:k]
                else:
                    k //= 2
        history.append((round_no, domain.auc, best, dropped))
        if not dropped:
            break
    table = train.sparkSession.createDataFrame(
        history, "step int, domain_auc double, composite double, dropped array<string>"
    )
    return keep, table


def one_by_one_filter(
    train: DataFrame, test: DataFrame, features: Sequence[str], tolerance: float = 0.0, tries: int | None = None,
    learner: Learner = Learner(), last_n: int = 6, seeds: Sequence[int] = (1,)
) -> tuple[list[str], DataFrame]:
    """Try the features one at a time, the most drifting first; drop those whose loss stays within ``tolerance``.

    All are tried unless ``tries`` says how many.
    """
    keep = list(features)
    best = train_oof(train, keep, learner, last_n=last_n, seeds=seeds).composite(last_n)
    history = []
    for f in domain_classifier(train, test, keep, learner, holdout=True).ranked()[:tries]:
        if len(keep) == 1:
            break
        score = train_oof(train, [c for c in keep if c != f], learner, last_n=last_n, seeds=seeds).composite(last_n)
        ok = bool(score - best >= -tolerance)
        history.append((f, score - best, ok))
        if ok:
            keep.remove(f)
            best = score
    return keep, train.sparkSession.createDataFrame(history, "feature string, change double, dropped boolean")


def drift_report(
    train: DataFrame, test: DataFrame, features: Sequence[str], threshold: float = 0.70, fail: bool = False,
    learner: Learner = Learner()
) -> DataFrame:
    """One row: domain AUC against the threshold; raises when asked to and the threshold is passed."""
    d = domain_classifier(train, test, features, learner, holdout=True)
    if fail and d.auc > threshold:
        raise ValueError(f"domain AUC {d.auc:.4f} above {threshold}")
    return train.sparkSession.createDataFrame(
        [(d.auc, threshold, bool(d.auc > threshold))], "domain_auc double, threshold double, drifting boolean"
    )


def permutation_importance(domain: Domain, rows: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """(feature, drop): fall of the AUC when one feature's values are exchanged between rows.

    Values move between rows by joining two hash orders on the row number, so nothing is gathered in one task. The rows are
    scored as they are and with each feature changed in one job, and one more finds all the AUCs.
    """
    from ebbtide.operators.ranks import row_numbers

    _, _, model = domain.result.models[0]
    learner = domain.result.learner
    h = [F.xxhash64(*KEYS, F.lit(seed + i)) for i in (0, 1)]
    base = materialize(rows.select(*KEYS, "domain", *features))
    one = row_numbers(base, [], [h[0], *map(F.col, KEYS)], "_place")
    two = row_numbers(base, [], [h[1], *map(F.col, KEYS)], "_place")
    swapped = materialize(one.join(two.select("_place", *[F.col(f).alias(f"o_{f}") for f in features]), "_place"))

    def scores(changed: str | None) -> DataFrame:
        cols = [F.col(f"o_{f}").alias(f) if f == changed else F.col(f) for f in features]
        got = model.transform(assemble(swapped.select(*KEYS, "domain", *cols), features, "domain"))
        return got.select(F.lit(changed).cast("string").alias("changed"), F.col("y").cast("int").alias("y"), learner.score(got).alias("p"))

    every = reduce(DataFrame.unionByName, [scores(f) for f in (None, *features)])
    found = {r.changed: r.auc for r in auc(every, ["changed"]).collect()}  # one row a feature
    out = [(f, found[None] - found[f]) for f in features]
    return rows.sparkSession.createDataFrame(out, "feature string, drop double")


def attribution_importance(domain: Domain, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, gain): mean size of a feature's Shapley values in the first model, which must be of second-order trees."""
    _, _, model = domain.result.models[0]
    return model.mean_contributions(assemble(rows, features, "domain"), features)


def mean_rank(gain: DataFrame, other: DataFrame) -> DataFrame:
    """(feature, mean_rank) of two importance tables; one row per feature name."""
    from pyspark.sql import Window

    def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.select("feature", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(value))).alias(name))

    g = gain.groupBy("feature").agg(F.avg("gain").alias("gain"))
    both = ranked(g, "gain", "r1").join(ranked(other, "drop", "r2"), "feature")
    return both.select("feature", ((F.col("r1") + F.col("r2")) / F.lit(2.0)).alias("mean_rank"))
