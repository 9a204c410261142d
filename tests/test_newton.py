"""Second-order trees against a plain numpy fit over the same bins, and their behaviour."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from ebbtide.plans import newton, oof


def frame(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = rng.integers(0, 3, n)
    x[::40, 1] = np.nan
    y = (x[:, 0] + (x[:, 2] == 1) + rng.normal(size=n) > 0.8).astype(float)
    pdf = pd.DataFrame({"cust_id": np.arange(n), "ref_date": [dt.date(2000, 1 + i % 6, 1) for i in range(n)], "y": y, "w": 0.5 + rng.random(n),
                        **{f"f{i}": x[:, i] for i in range(3)}})
    df = spark.createDataFrame(pdf).repartition(5)
    return pdf, VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features", handleInvalid="keep").transform(df)


def plain_fit(x, y, w, rounds, depth, rate, l1, l2, child, bins):
    """The same algorithm row by row: every split of every node tried outright."""
    edges = [np.unique(np.percentile(c[~np.isnan(c)], [100 * i / bins for i in range(1, bins)])) for c in x.T]
    share = (w * y).sum() / w.sum()
    margin = np.full(len(y), np.log(share / (1 - share)))
    soft = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    score = lambda g, h: soft(g) ** 2 / (h + l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows, level):
            best = None
            if level < depth:
                for f in range(x.shape[1]):
                    for b, e in enumerate(edges[f]):
                        left = rows & (x[:, f] < e)
                        right = rows & ~left
                        if h[left].sum() >= child and h[right].sum() >= child:
                            gain = round(score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum()), 9)
                            if best is None or gain > best[0]:
                                best = gain, left, right
            if best is None or best[0] <= newton.LEAST_GAIN:
                step[rows] = -rate * soft(g[rows].sum()) / (h[rows].sum() + l2)
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(np.ones(len(y), dtype=bool), 0)
        margin = margin + step
    return margin


def test_trees_equal_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(newton, "REFRESH", 2)
    pdf, df = frame(spark)
    kw = dict(rounds=3, depth=3, rate=0.3, l1=0.1, l2=1.0, child=1.0, bins=12)
    model = newton.NewtonBooster(row_share=1.0, column_share=1.0, **kw).fit(df)
    x = pdf[["f0", "f1", "f2"]].to_numpy()
    assert model.margins(x) == pytest.approx(plain_fit(x, pdf.y.to_numpy(), pdf.w.to_numpy(), **kw), abs=1e-9)
    got = model.transform(df).select("cust_id", "score").toPandas().sort_values("cust_id")
    assert got.score.to_numpy() == pytest.approx(1 / (1 + np.exp(-model.margins(x))))
    assert sum(model.featureImportances) == pytest.approx(1) and model.featureImportances[0] == max(model.featureImportances)


def test_draws_do_not_depend_on_how_rows_are_dealt(spark):
    pdf, df = frame(spark, 600)
    fit = newton.NewtonBooster(rounds=2, depth=2, row_share=0.5, column_share=0.7, bins=8, seed=11)
    x = pdf[["f0", "f1", "f2"]].to_numpy()
    assert fit.fit(df).margins(x) == pytest.approx(fit.fit(df.repartition(2)).margins(x), abs=1e-9)
    u = newton._uniform(np.arange(20_000, dtype=np.int64) * 7919, 3, 5)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01


def test_one_class_and_early_stopping(spark):
    from pyspark.sql import functions as F

    pdf, df = frame(spark, 600)
    constant = newton.NewtonBooster(rounds=3, depth=2, bins=8).fit(df.withColumn("y", F.lit(0.0)))
    assert (1 / (1 + np.exp(-constant.margins(np.zeros((2, 3)))))).max() < 0.001
    split = df.withColumn("is_valid", F.month("ref_date") == 6)
    for rows in (split, split.withColumn("y", F.when(F.col("is_valid"), 0.0).otherwise(F.col("y")))):  # the second by log loss
        model = newton.NewtonBooster(rounds=8, depth=2, rate=1.0, bins=8, patience=2, row_share=1.0, column_share=1.0).fit(rows)
        scores = [h["score"] for h in model.history]
        assert len(model.trees) == int(np.argmax(scores)) + 1 and len(scores) <= 8


def test_second_stream_out_of_fold(spark):
    pdf, df = frame(spark, 900)
    matrix = df.drop("features", "w").withColumnRenamed("y", "churn")
    learner = oof.Learner("newton", {"rounds": 3, "depth": 2, "bins": 8})
    got = oof.train_oof(matrix, ["f0", "f2"], learner, last_n=2, seeds=(1, 2))
    assert got.oof.count() == 300 and got.composite(2) > 0.5
    assert got.predict(matrix).count() == 900


def test_attributions_by_definition(spark):
    """Every set of features known in turn, all others drawn by cover."""
    from itertools import combinations
    from math import factorial

    pdf, df = frame(spark, 400)
    model = newton.NewtonBooster(rounds=2, depth=4, rate=0.5, bins=8, row_share=1.0, column_share=1.0).fit(df)
    x = pdf[["f0", "f1", "f2"]].to_numpy()[:60]

    def value(t, row, known, at=0):
        f = t.feature[at]
        if f < 0:
            return t.value[at]
        left, right = (value(t, row, known, 2 * at + s) for s in (1, 2))
        if f in known:
            return left if row[f] < t.threshold[at] else right
        a, b = t.cover[2 * at + 1], t.cover[2 * at + 2]
        return (a * left + b * right) / (a + b)

    got, mean = model.contributions(x)
    assert mean == pytest.approx(model.base + sum(value(t, x[0], set()) for t in model.trees)) and mean == pytest.approx(model.expected())
    assert got.sum(axis=1) + mean == pytest.approx(model.margins(x))
    for n, row in enumerate(x):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(s) * factorial(2 - s) / 6 * sum(value(t, row, {*c, i}) - value(t, row, set(c)) for t in model.trees)
                       for s in range(3) for c in combinations(others, s))
            assert got[n, i] == pytest.approx(want, abs=1e-9)
    ranked = model.mean_contributions(df, ["f0", "f1", "f2"]).collect()
    assert [r.feature for r in ranked][0] == "f0" and len(ranked) == 3


def test_bootstrap_weights(spark):
    w = newton.bootstrap_weights(np.arange(50_000, dtype=np.int64) * 7919, 3, 5, 1.0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.std() - 1) < 0.03 and (w >= 0).all()  # exponential
    assert (newton.bootstrap_weights(np.arange(9, dtype=np.int64), 3, 5, 0.0) == 1).all()
    pdf, df = frame(spark, 600)
    x = pdf[["f0", "f1", "f2"]].to_numpy()
    fit = newton.NewtonBooster(rounds=2, depth=2, bins=8, bootstrap=1.0, row_share=1.0)
    drawn = fit.fit(df).margins(x)
    assert drawn == pytest.approx(fit.fit(df.repartition(2)).margins(x), abs=1e-9)
    assert np.abs(drawn - newton.NewtonBooster(rounds=2, depth=2, bins=8, row_share=1.0).fit(df).margins(x)).max() > 1e-4


def test_halving_stops():
    assert oof.stops({0: 0.5, 1: 0.7, 2: 0.6, 3: 0.4}, False) == {0: "median", 3: "median"}
    assert oof.stops({0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5}, True) == {2: "halving", 3: "halving"}
    assert oof.stops({0: float("nan"), 1: 0.2, 2: 0.1}, True) == {0: "median"}
    assert oof.stops({4: 0.3}, True) == {}


def test_halving_search_keeps_what_its_scores_say(spark):
    pdf, df = frame(spark, 900)
    matrix = df.drop("features", "w").withColumnRenamed("y", "churn")
    tries = [oof.Learner("newton", {"rounds": 2, "depth": d, "bins": 8, "rate": r}) for d, r in ((1, 0.01), (2, 0.3), (2, 0.1))]
    table = oof.halving_search(matrix, ["f0", "f2"], tries, last_n=3, gap=0).toPandas()
    folds = sorted(table.fold.unique())
    alive, seen = set(range(3)), {i: [] for i in range(3)}
    for n, fold in enumerate(folds):
        now = table[table.fold == fold].set_index("candidate")
        assert set(now.index) == alive
        for i in alive:
            seen[i].append(now.composite[i])
            assert now["mean"][i] == pytest.approx(np.mean(seen[i]))
        want = {} if n == 2 else oof.stops({i: float(np.mean(seen[i])) for i in alive}, n == 0)
        assert {i: s for i, s in now.state.items() if s not in ("kept", "finished")} == want
        alive -= set(want)
    assert set(table[table.state == "finished"].candidate) == alive and alive


def test_halving_search_prepares_a_fold_once_for_all(spark, monkeypatch):
    pdf, df = frame(spark, 900)
    matrix = df.drop("features", "w").withColumnRenamed("y", "churn")
    tries = [oof.Learner("newton", {"rounds": 2, "depth": d, "bins": 8, "rate": r}) for d, r in ((1, 0.01), (2, 0.3), (2, 0.1))]
    cut, made = [], newton.column_percentiles
    monkeypatch.setattr(newton, "column_percentiles", lambda *a: cut.append(1) or made(*a))
    table = oof.halving_search(matrix, ["f0", "f2"], tries, last_n=2, gap=0).toPandas()
    assert len(cut) == table.fold.nunique() == 2 < len(table)
    rows = oof.materialize(oof.assemble(matrix, ["f0", "f2"]))
    split = oof.month_splits(rows, 2, 0)[0]
    for r in table[table.fold == split.name].itertuples():
        assert r.composite == pytest.approx(oof.fit_folds(rows, ["f0", "f2"], [split], tries[r.candidate], (1,), 0.2).composite(1), abs=1e-12)


def test_search_of_mixed_learners_and_seeds(spark):
    pdf, df = frame(spark, 600)
    matrix = df.drop("features", "w").withColumnRenamed("y", "churn")
    rows = oof.materialize(oof.assemble(matrix, ["f0", "f2"]))
    split = oof.month_splits(rows, 1, 0)[0]
    tries = {4: oof.Learner("newton", {"rounds": 1, "depth": 2, "bins": 8}), 2: oof.Learner("logistic"),
             7: oof.Learner("newton", {"rounds": 2, "depth": 1, "bins": 4}, early_stop=True)}
    got = oof._fold_composites(rows, ["f0", "f2"], split, tries, (1, 5), 0.2, 2)
    want = {i: oof.fit_folds(rows, ["f0", "f2"], [split], c, (1, 5), 0.2).composite(1) for i, c in tries.items()}
    assert list(got) == [4, 2, 7] and got == pytest.approx(want, abs=1e-12)


def test_grown_together_as_alone(spark, monkeypatch):
    monkeypatch.setattr(newton, "REFRESH", 2)
    pdf, df = frame(spark, 600)
    x = pdf[["f0", "f1", "f2"]].to_numpy()
    kinds = [dict(rounds=3, depth=3, rate=0.3), dict(rounds=1, depth=1, rate=0.1, seed=5), dict(rounds=4, depth=2, l1=0.5, row_share=0.5, bootstrap=1.0)]
    boosters = [newton.NewtonBooster(bins=8, **kw) for kw in kinds]
    for booster, model in zip(boosters, newton.fit_together(boosters, df)):
        assert len(model.trees) == booster.rounds
        assert model.margins(x) == pytest.approx(booster.fit(df).margins(x), abs=1e-9)
    with pytest.raises(ValueError):
        newton.fit_together([boosters[0], newton.NewtonBooster(bins=9)], df)


def test_saved_trees(spark, tmp_path):
    from ebbtide.plans import store

    pdf, df = frame(spark, 600)
    matrix = df.drop("features", "w").withColumnRenamed("y", "churn")
    made = oof.train_oof(matrix, ["f0", "f1"], oof.Learner("newton", {"rounds": 2, "depth": 2, "bins": 8}), last_n=2, seeds=(1,))
    store.save_result(made, f"{tmp_path}/trees")
    again = store.load_result(spark, f"{tmp_path}/trees")
    a, b = (r.predict(matrix).toPandas().sort_values(["cust_id", "ref_date"]).p.to_numpy() for r in (made, again))
    assert a == pytest.approx(b, abs=0) and again.composite(2) == made.composite(2)
