"""Drift jobs and stackers read written folds; how often they count, write and fold is bounded."""

import datetime

from ebbtide.operators import folds as fold_ops
from ebbtide.plans import drift, oof, stacking
from ebbtide.runtime import materialize

FEATURES = ["u", "v"]
DAY = datetime.date(2000, 1, 1)


def side(spark, start, shift):
    rows = [(i, DAY, float(i * 7 % 11 + shift), float(i % 5), i % 3 % 2) for i in range(start, start + 60)]
    return materialize(spark.createDataFrame(rows, "cust_id long, ref_date date, u double, v double, churn int"))


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **kw: calls.append(name) or real(*a, **kw))
    return calls


def test_domain_rows_are_written(spark):
    rows = drift.domain_rows(side(spark, 0, 0), side(spark, 100, 3), FEATURES)
    assert rows.inputFiles() and rows.count() == 120
    assert {r["count"] for r in rows.groupBy("domain", "fold").count().collect()} == {12}


def test_exchange_of_every_feature_takes_one_auc(spark, monkeypatch):
    train, test = side(spark, 0, 0), side(spark, 100, 3)
    domain = drift.domain_classifier(train, test, FEATURES, oof.Learner("logistic"), holdout=True)
    rows = drift.domain_rows(train, test, FEATURES)
    calls = counted(monkeypatch, drift, "auc")
    drop = {r.feature: r.drop for r in drift.permutation_importance(domain, rows, FEATURES).collect()}
    assert len(calls) == 1
    # Only the shifted feature tells the sides apart.
    assert set(drop) == set(FEATURES) and drop["u"] > 0.05 > abs(drop["v"])


def test_rows_drawn_by_key_are_not_written_per_fold(spark, monkeypatch):
    both = drift.domain_rows(side(spark, 0, 0), side(spark, 100, 3), FEATURES)
    rows = materialize(oof.assemble(both, FEATURES, "domain", keep=["fold"]))
    splits = oof.column_splits("fold", 5)
    calls = counted(monkeypatch, oof, "materialize")
    got = oof.fit_folds(rows, FEATURES, splits, oof.Learner("logistic"))
    assert len(calls) == 2 and got.oof.count() == 120


def test_stackers_share_their_folds(spark, monkeypatch):
    meta = side(spark, 0, 0)
    calls = counted(monkeypatch, fold_ops, "stratified_folds")
    got = stacking.compare_stackers(meta, ["u"], ["v"], oof.Learner("gbt", {"maxIter": 1, "maxDepth": 1}), 2)
    assert got.count() == 4 and len(calls) == 1
    alone = stacking.kfold_stacker(meta, FEATURES, k=2).oof
    assert alone.count() == 60 and alone.select("fold").distinct().count() == 2
