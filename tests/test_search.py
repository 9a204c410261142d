"""Blend search: bounds hold, and the pruned search equals ranking every candidate."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import blend, metrics, search
from ebbtide.runtime import materialize

NAMES = ["a", "b", "c"]


def frame(spark, seed, n=900, months=3, scale=1.0, digits=None):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 5, n) == 0
    pdf = pd.DataFrame({"cust_id": np.arange(n), "ref_date": [dt.date(2000, 1 + i % months, 28) for i in range(n)], "y": y.astype(int)})
    for i, s in enumerate(NAMES):
        x = rng.random(n) + (0.4 - 0.5 * i) * y
        pdf[s] = (np.round(x, digits) if digits is not None else x) * scale
    return spark.createDataFrame(pdf)


def every(df, grid, top):
    """Full ranking of every candidate, best first."""
    scored = blend.score_candidates(df, NAMES, grid).select("month", "candidate", "composite").toPandas()
    out = []
    for m, some in scored.groupby("month"):
        some = some.assign(r=some.composite.round(9)).sort_values(["r", "candidate"], ascending=[False, True], na_position="last")
        out += [(m, c, i + 1) for i, c in enumerate(some.candidate[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed,scale,digits", [(1, 1.0, None), (2, 1e-13, None), (3, 1.0, 1), (4, 1e9, 0)])
def test_the_pruned_search_equals_the_full_one(spark, monkeypatch, seed, scale, digits):
    monkeypatch.setattr(search, "ROUNDS", ((8, 100), (32, 200)))
    monkeypatch.setattr(search, "LOT", 30)
    df = frame(spark, seed, scale=scale, digits=digits)
    grid = blend.simplex_grid(NAMES, 10)
    got = blend.best_candidates(df, NAMES, grid, top=4).toPandas()
    assert sorted(zip(got.month, got.candidate, got.place)) == every(df, grid, 4)


def test_bounds_hold_and_rule_most_candidates_out(spark):
    df = frame(spark, 5, n=4000)
    rows = materialize(df.select("cust_id", "ref_date", F.date_format("ref_date", "yyyy-MM").alias("_group"), F.col("y").alias("_y"), *NAMES))
    grid = blend.simplex_grid(NAMES, 10)
    names = ["2000-01", "2000-02", "2000-03"]
    samples = search.sample_scores(rows, NAMES, 500)
    assert all(len(x) == 500 for columns in samples.values() for x in columns)
    bounded = search.candidate_bounds(rows, NAMES, {m: list(enumerate(grid)) for m in names}, samples, 128)
    found = {(r._group, r.candidate): (r.low, r.high) for r in bounded.collect()}
    exact = blend.score_candidates(df, NAMES, grid).collect()
    assert len(exact) == len(found) == 3 * len(grid)
    for r in exact:
        low, high = found[r.month.strftime("%Y-%m"), r.candidate]
        assert low - 1e-9 <= r.composite <= high + 1e-9
    assert all(len(c) < len(grid) / 3 for c in search.survivors(bounded).values())


def test_tied_scores_are_told_apart_by_their_counts(spark):
    # Streams of few values: a bin that holds one of them leaves nothing open but the border of the top share.
    df = frame(spark, 8, n=3000, digits=1)
    rows = materialize(df.select("cust_id", "ref_date", F.date_format("ref_date", "yyyy-MM").alias("_group"), F.col("y").alias("_y"), *NAMES))
    grid = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.5, 0.5, 0.0]]
    names = ["2000-01", "2000-02", "2000-03"]
    bounded = search.candidate_bounds(rows, NAMES, {m: list(enumerate(grid)) for m in names}, search.sample_scores(rows, NAMES, 1000), 512, share=1.0, flip=False)
    found = {(r._group, r.candidate): (r.low, r.high) for r in bounded.collect()}
    assert len(found) == 9
    for r in metrics.ranking_metrics(blend.with_candidates(rows, NAMES, grid), ["_group", "candidate"], label="_y", share=1.0).collect():
        low, high = found[r._group, r.candidate]
        assert low - 1e-9 <= r.composite <= high + 1e-9 and high - low < 1e-3


def test_odd_groups(spark):
    df = frame(spark, 6, n=300)
    odd = df.withColumn("y", F.when(F.month("ref_date") == 1, 0).otherwise(F.col("y")))  # one class: no composite
    odd = odd.withColumn("a", F.when(F.col("cust_id") % 7 > 0, F.col("a"))).withColumn("y", F.when(F.col("cust_id") % 11 > 0, F.col("y")))
    odd = odd.unionByName(odd.where("cust_id < 30"))  # repeated rows
    grid = [[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]
    got = blend.best_candidates(odd, NAMES, grid, top=2).toPandas()
    assert sorted(zip(got.month, got.candidate, got.place)) == every(odd, grid, 2)
    assert blend.best_candidates(odd.limit(0), NAMES, grid).count() == 0


def test_sweeps_equal_ranking_every_copy(spark):
    df = frame(spark, 7, n=600).withColumn("p", F.when(F.col("cust_id") % 9 == 0, 1 - F.col("a") * 1e-9).otherwise(F.col("a") / 3))
    for values, fn in (((0.5, 1.0, 2.0), lambda p, g: F.least(F.pow(p, g), F.lit(1 - 1e-6))), ((0.0, -1.0, 1.0), F.pow)):
        got = {r.candidate: r.composite for r in blend.sweep(df, [], values, fn).collect()}
        for i, g in enumerate(values):
            want = metrics.monthly_composite(df.withColumn("p", fn(F.col("p"), F.lit(g)))).first().composite
            assert got[i] == pytest.approx(want, abs=1e-12)


def test_equal_vectors_are_scored_once_and_tied_rows_stay_apart(spark, monkeypatch):
    df = frame(spark, 8, n=600, digits=1).withColumn(NAMES[0], F.when(F.col("cust_id") % 11 != 0, F.col(NAMES[0])))
    df = df.unionByName(df.where("cust_id < 50"))  # rows that come twice
    grid = blend.simplex_grid(NAMES, 4)
    plain = metrics.ranking_metrics(blend.with_candidates(df.withColumn("month", F.trunc("ref_date", "month")), NAMES, grid), ["month", "candidate"], flip=True)
    want = {(r.month, r.candidate): (r.n, r.positives, r.k, r.hits, r.auc, r.composite) for r in plain.collect()}
    sizes = []
    rank = blend.ranking_metrics
    monkeypatch.setattr(blend, "ranking_metrics", lambda rows, *a, **k: (sizes.append(rows.count()), rank(rows, *a, **k))[1])
    got = {(r.month, r.candidate): (r.n, r.positives, r.k, r.hits, r.auc, r.composite) for r in blend.score_candidates(df, NAMES, grid).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    distinct = df.select(F.trunc("ref_date", "month"), "y", *NAMES).distinct().count()
    assert sizes == [distinct * len(grid)] and distinct < df.count()


@pytest.mark.parametrize("seed,digits,sizes", [(9, None, (40, 50, 4)), (10, 1, (40, 50, 1))])
def test_ranked_candidates_equal_ranking_a_copy_for_each(spark, monkeypatch, seed, digits, sizes):
    for name, value in zip(("HELD", "PER_RANGE", "SEGMENTS"), sizes):
        monkeypatch.setattr(search, name, value)
    df = frame(spark, seed, n=700, digits=digits).withColumn("a", F.when(F.col("cust_id") % 40 == 0, float("inf")).otherwise(F.col("a") - 0.5))
    df = df.unionByName(df.where("cust_id < 50"))  # rows that come twice
    rows = df.select("cust_id", "ref_date", F.date_format("ref_date", "yyyy-MM").alias("_group"), F.col("y").alias("_y"), *NAMES)
    grid = blend.simplex_grid(NAMES, 4) + [[0.0, 0.0, 0.0]]  # an infinite score by 0 is no number and has no rank
    months = ["2000-01", "2000-02", "2000-03"]
    ready = search.prepared(rows, NAMES, blend.KEYS)
    for share, flip in ((0.1, True), (0.7, False)):
        got = search.ranked(ready, {m: dict(enumerate(grid)) for m in months}, share, flip).collect()
        want = metrics.ranking_metrics(blend.with_candidates(rows, NAMES, grid), ["_group", "candidate"], label="_y", share=share, flip=flip).collect()
        assert len(want) == 3 * len(grid)
        assert {(r._group, r.candidate): r.asDict() for r in got} == {(r._group, r.candidate): r.asDict() for r in want}


def plain_composite(y, p, share=metrics.TOP_SHARE):
    """By hand, rows in the order of their ids."""
    wins = (p[y == 1][:, None] > p[y == 0]).sum() + (p[y == 1][:, None] == p[y == 0]).sum() / 2
    auc = wins / ((y == 1).sum() * (y == 0).sum())
    k = max(1, int(np.rint(share * len(y))))
    hits = y[np.argsort(p if auc < 0.5 else -p, kind="stable")[:k]].sum()
    gini = 2 * max(auc, 1 - auc) - 1
    wg, wr, wl = metrics.WEIGHTS
    return gini / (2 * metrics.BASE_AUC - 1) * wg + hits / y.sum() / metrics.BASE_RECALL * wr + hits / k / y.mean() / metrics.BASE_LIFT * wl


@pytest.mark.parametrize("digits", [None, 1])
def test_rounds_of_a_search_write_rows_once_and_look_at_a_vector_once(spark, monkeypatch, digits):
    df = frame(spark, 12, n=500, months=2, digits=digits)
    written, looked, ranked = [], [], []
    write, bound, rank = search.materialize, search.candidate_bounds, search.ranked
    monkeypatch.setattr(search, "materialize", lambda t: (made := write(t), written.append(made.count()))[0])
    monkeypatch.setattr(blend, "materialize", search.materialize)
    monkeypatch.setattr(search, "candidate_bounds", lambda rows, streams, grids, samples, bins, *a: (
        looked.extend((g, tuple(w)) for g, some in grids.items() for _, w in some if bins == search.ROUNDS[0][0]),
        bound(rows, streams, grids, samples, bins, *a))[1])
    monkeypatch.setattr(search, "ranked", lambda ready, left, *a: (ranked.append(left), rank(ready, left, *a))[1])
    units = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    got = {(f"{r.month:%Y-%m}", r.model): (r.w, r.composite) for r in blend.search_per_month(df, NAMES, rounds=3, draws=3, starts=units).collect()}
    assert written.count(500) == 2 and max(written) == 500
    assert len(looked) == len(set(looked)) > 2 * 30
    assert len(ranked) == 3

    # The same rounds, every candidate scored by hand.
    data = {m: some.sort_values(["cust_id", "ref_date"]) for m, some in df.toPandas().groupby(df.toPandas().ref_date.map(lambda d: f"{d:%Y-%m}"))}
    rng, best = blend.random.Random(42), {}
    for _ in range(3):
        for m in sorted(data):
            centre = best[m][1] if m in best else [1 / 3] * 3
            pool = [centre] if m in best else [centre, *units]
            pool += [[(1 - s / 10) * w + (s / 10 if j == i else 0.0) for j, w in enumerate(centre)] for i in range(3) for s in range(1, 11)]
            pool += [blend._dirichlet(rng, [1.0 + 50.0 * w for w in centre]) for _ in range(3)]
            columns, y = [data[m][s].to_numpy() for s in NAMES], data[m].y.to_numpy()
            scores = [plain_composite(y, search.blended(columns, w)) for w in pool]
            at = max(range(len(pool)), key=lambda i: (round(scores[i], 9), -i))
            if m not in best or scores[at] > best[m][0]:
                best[m] = (scores[at], pool[at])
    for m, (score, weights) in best.items():
        for s, w in zip(NAMES, weights):
            assert got[m, s] == pytest.approx(((1 - 1e-4) * w + 1e-4 / 3, score), abs=1e-12)


def test_a_search_makes_no_copies_of_rows(spark, monkeypatch):
    df = frame(spark, 13, n=600, digits=1)
    grid = blend.simplex_grid(NAMES, 5)
    grid += grid[:3]  # equal vectors have places of their own
    want = every(df, grid, 4)
    monkeypatch.setattr(search.metrics, "ranking_metrics", None)
    got = blend.best_candidates(df, NAMES, grid, top=4).toPandas()
    assert sorted(zip(got.month, got.candidate, got.place)) == want
