"""Stackers: a second model on the base streams, by month folds, k folds or forward blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators import folds as fold_ops
from ebbtide.operators.correlation import to_wide
from ebbtide.operators.metrics import ranking_metrics
from ebbtide.plans.oof import KEYS, Learner, OofResult, assemble, column_splits, fit_folds, month_splits, train_oof
from ebbtide.runtime import materialize

# The grids of the selector.
LOGISTIC_C = (0.1, 1.0, 10.0)
RIDGE_ALPHA = (0.1, 1.0, 10.0)


def meta_features(
    predictions: DataFrame, models: Sequence[str], raw: DataFrame | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """One column per base model (prefix ``oof_``), the label, and chosen raw features.

    Rows without all streams are left out: their out-of-fold score does not exist.
    """
    wide = to_wide(predictions, models, [*KEYS, "y"]).dropna(subset=list(models))
    wide = wide.select(*KEYS, F.col("y").alias("churn"), *[F.col(m).alias(f"oof_{m}") for m in models])
    return wide.join(raw.select(*KEYS, *columns), KEYS, "left") if raw is not None else wide


def logistic(c: float = 1.0) -> Learner:
    """Ridge-penalised logistic regression on standardised inputs; ``c`` weighs the sum of losses against the penalty, whatever the rows."""
    return Learner("logistic", {"c": c})


def month_stacker(meta: DataFrame, features: Sequence[str], learner: Learner = logistic(), last_n: int = 6, gap: int = 1) -> OofResult:
    return train_oof(meta, features, learner, last_n=last_n, gap=gap, lam=None, seeds=(1,))


def kfold_stacker(meta: DataFrame, features: Sequence[str], learner: Learner = logistic(), k: int = 5, seed: int = 42) -> OofResult:
    return _on_folds(materialize(_folded(meta, features, k, seed)), features, learner, k)


def _folded(meta: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    slim = meta.select(*dict.fromkeys([*KEYS, "churn", *features]))
    return fold_ops.stratified_folds(slim, "churn", KEYS, k, seed)


def _on_folds(folded: DataFrame, features: Sequence[str], learner: Learner, k: int) -> OofResult:
    return fit_folds(assemble(folded, features, keep=["fold"]), features, column_splits("fold", k), learner)


def compare_stackers(meta: DataFrame, streams: Sequence[str], extra: Sequence[str], boosted: Learner, k: int = 5) -> DataFrame:
    """(stacker, auc, composite) of logistic and boosted, on streams alone and with raw features; best first.

    A row's fold depends on its keys and label alone, so all four stackers read the same written folds.
    """
    rows = []
    folded = materialize(_folded(meta, [*streams, *extra], k))
    for name, learner in (("logistic", logistic()), ("boosted", boosted)):
        for kind, features in (("streams", list(streams)), ("streams and features", [*streams, *extra])):
            m = ranking_metrics(_on_folds(folded, features, learner, k).oof).first()
            rows.append((f"{name}, {kind}", m.auc, m.composite))
    made = meta.sparkSession.createDataFrame(rows, "stacker string, auc double, composite double")
    return made.orderBy(F.desc_nulls_last("composite"), "stacker")


def forward_stacker(
    meta: DataFrame, features: Sequence[str], cs: Sequence[float] = LOGISTIC_C, k: int = 5
) -> tuple[OofResult, float]:
    """Logistic stacker on forward blocks; the penalty with the best mean fold AUC wins and its block scores are
    the out-of-fold scores."""
    from ebbtide.operators.metrics import auc

    tiled = materialize(fold_ops.forward_tiles(assemble(meta, features), ["ref_date", "cust_id"], k))
    best: tuple[float, float, OofResult] | None = None
    for c in cs:
        got = fit_folds(tiled, features, column_splits("tile", k, forward=True), logistic(c))
        score = auc(got.oof, ["fold"]).agg(F.avg("auc")).first()[0] or 0.0
        if best is None or score > best[0]:
            best = (score, c, got)
    return best[2], best[1]


@dataclass
class Selected:
    family: str
    oof: DataFrame
    scores: DataFrame


def select_meta(
    meta: DataFrame, features: Sequence[str], families: dict[str, Sequence[Learner]] | None = None, last_n: int = 6, gap: int = 1
) -> Selected:
    """Pick a stacker family without peeking: the setting used for a month is the best on the months before it.

    (The first month takes each family's first setting.) The family with the best mean composite wins.
    """
    if families is None:
        families = {
            "logistic": [logistic(c) for c in LOGISTIC_C],
            "ridge": [Learner("ridge", {"regParam": a}) for a in RIDGE_ALPHA],
            "boosted": [Learner(params={"maxDepth": d, "maxIter": 10}) for d in (2, 3)],
        }
    rows = materialize(assemble(meta, features))
    splits = month_splits(rows, last_n, gap)
    chosen, summary = {}, []
    for family, settings in families.items():
        scored = []
        for s in settings:
            got = fit_folds(rows, features, splits, s)
            by_fold = {r.fold: r.composite for r in ranking_metrics(got.oof, ["fold"]).collect()}
            scored.append((got.oof, by_fold))
        picked, used = [], []
        for i, split in enumerate(splits):
            past = [s.name for s in splits[:i]]

            def mean(by_fold: dict, names=past) -> float:
                known = [by_fold[n] for n in names if by_fold.get(n) is not None]
                return sum(known) / len(known) if known else 0.0

            j = max(range(len(scored)), key=lambda j: (round(mean(scored[j][1]), 9), -j)) if past else 0
            picked.append(scored[j][0].where(F.col("fold") == split.name))
            used.append(scored[j][1].get(split.name))
        out = picked[0]
        for p in picked[1:]:
            out = out.unionByName(p)
        known = [u for u in used if u is not None]
        summary.append((family, sum(known) / len(known) if known else None))
        chosen[family] = out
    best = max(summary, key=lambda x: x[1] if x[1] is not None else float("-inf"))[0]
    table = meta.sparkSession.createDataFrame(summary, "family string, composite double")
    return Selected(best, chosen[best], table)
