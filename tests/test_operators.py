"""Folds, blends, clusters, calibration, readers: properties and small brute-force checks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import blend, correlation, folds, quality
from ebbtide.plans import calibration, oof, portfolio, stacking
from ebbtide.sources import scores, tables

MONTHS = [dt.date(2000, m, 1) for m in range(1, 13)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 1200
    pdf = pd.DataFrame({
        "cust_id": np.arange(n) % 100, "ref_date": [MONTHS[i // 100] for i in range(n)],
        "x1": rng.normal(size=n), "x2": rng.normal(size=n),
    })
    pdf["churn"] = (pdf.x1 + rng.normal(size=n) > 0.5).astype(int)
    return spark.createDataFrame(pdf, "cust_id long, ref_date date, x1 double, x2 double, churn int").cache()


def test_month_folds_keep_the_gap(rows):
    table = folds.month_folds(rows, 6, 1).collect()
    assert {r.fold for r in table} == set(MONTHS[-6:])
    for r in table:
        gap = (r.fold.year - r.month.year) * 12 + r.fold.month - r.month.month
        assert gap == 0 if r.role == "valid" else gap >= 2


def test_decay_weights_have_mean_one(rows):
    got = folds.decay_weights(rows, folds.month_folds(rows)).groupBy("fold").agg(F.avg("w").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in got)


def test_stratified_folds_are_balanced(rows):
    got = folds.stratified_folds(rows, "churn", ["cust_id", "ref_date"], 5).groupBy("churn", "fold").count().toPandas()
    assert (got.groupby("churn")["count"].max() - got.groupby("churn")["count"].min() <= 1).all()


def test_oof_covers_exactly_the_validation_months(rows):
    got = oof.train_oof(rows, ["x1", "x2"], oof.Learner("gbt", {"maxIter": 3, "maxDepth": 2}), last_n=2, seeds=(1, 2))
    pdf = got.oof.toPandas()
    assert set(pdf.ref_date) == set(MONTHS[-2:]) and len(pdf) == 200
    assert pdf.p.between(0, 1).all()
    assert got.importance().agg(F.sum("gain")).first()[0] == pytest.approx(2.0)
    again = oof.train_oof(rows, ["x1", "x2"], oof.Learner("gbt", {"maxIter": 3, "maxDepth": 2}), last_n=2, seeds=(1, 2))
    assert np.allclose(pdf.sort_values(["ref_date", "cust_id"]).p, again.oof.toPandas().sort_values(["ref_date", "cust_id"]).p)


def test_two_stage_scores_new_rows(rows):
    learner = oof.Learner("gbt", {"maxIter": 2, "maxDepth": 2})
    two = oof.train_two_stage(rows, ["x1", "x2"], learner, learner, last_n=2)
    assert two.stage_b.features[-3:] == ["pA", "rank_pA", "rank_boost"]
    assert two.predict(rows.where("ref_date = '2000-12-01'")).count() == 100


def test_pseudo_labels_are_exact(rows):
    got = oof.pseudo_labels(rows.withColumn("p", F.col("x1")).drop("churn")).groupBy("churn").count().collect()
    assert {r.churn: r["count"] for r in got} == {0: 480, 1: 30}


def test_forward_stacker_never_trains_on_later_rows(rows):
    got, _ = stacking.forward_stacker(rows, ["x1", "x2"], (1.0,), 3)
    assert got.oof.count() == 900 and got.oof.agg(F.min("ref_date")).first()[0] == dt.date(2000, 4, 1)


def stream(rows):
    return rows.select("cust_id", "ref_date", F.col("churn").alias("y"), F.round(1 / (1 + F.exp(-F.col("x1"))), 6).alias("p"))


def test_isotonic_is_monotone_and_beta_keeps_order(rows):
    s = stream(rows)
    raw = s.toPandas().sort_values(["ref_date", "cust_id"])
    for m in ("isotonic", "beta", "platt"):
        cal = calibration.fit(s, m).apply(s).toPandas().sort_values(["ref_date", "cust_id"])
        order = np.argsort(raw.p.to_numpy(), kind="stable")
        assert (np.diff(cal.p.to_numpy()[order]) >= -1e-9).all(), m
        assert cal.p.between(0, 1).all()
        assert cal.p.mean() == pytest.approx(raw.y.mean(), abs=0.03)


def test_segment_calibration_falls_back(rows):
    binned, n, _ = calibration.segment_bins(stream(rows).withColumn("v", F.col("cust_id").cast("double")), "v", 100)
    got = calibration.fit_segments(binned, n, min_rows=10_000)
    assert not got.own and got.apply(binned).count() == 1200


def test_out_of_fold_calibration_keeps_all_rows(rows):
    got = calibration.out_of_fold(folds.stratified_folds(stream(rows), "y", ["cust_id", "ref_date"], 3), "fold")
    assert got.count() == 1200


def test_clusters_follow_chains(spark):
    names = [f"n{i:02d}" for i in range(12)]
    links = [(a, b, 0.99) for a, b in zip(names[:9], names[1:9])] + [("n10", "n11", 0.985)]
    pairs = spark.createDataFrame(links, "a string, b string, corr double")
    got = {r.name: r.cluster for r in correlation.clusters(correlation.full_matrix(pairs, names)).collect()}
    assert {got[n] for n in names[:9]} == {"n00"}
    assert got["n09"] == "n09" and got["n10"] == got["n11"] == "n10"


def test_kendall_with_ties_and_nulls(spark):
    rnd = random.Random(9)
    draw = lambda: rnd.choice([None, 0.0, -0.0, 1e-12, *(rnd.randint(-3, 9) for _ in range(3)), rnd.random()])
    rows = [(draw(), draw(), draw(), 1.0, None) for _ in range(300)]
    rows = [tuple(None if v is None else float(v) for v in r) for r in rows]
    names = ["p", "q", "r", "same", "none"]
    got = {(r.a, r.b): r.corr for r in correlation.kendall_pairs(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3), names).collect()}
    sign = lambda v: (v > 0) - (v < 0)
    assert len(got) == 10
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            signs = [(sign(x[0] - y[0]), sign(x[1] - y[1])) for x in both for y in both]
            scale = (sum(map(abs, (s for s, _ in signs))) * sum(map(abs, (s for _, s in signs)))) ** 0.5
            want = sum(s * t for s, t in signs) / scale if scale else None
            assert got[a, names[j]] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_correlation_in_blocks(spark, monkeypatch):
    rows = spark.range(200).select(*[F.when((F.col("id") + i) % 4 != 0, F.rand(i)).alias(f"c{i}") for i in range(7)])
    rows = spark.createDataFrame(rows.toPandas(), "c0 double, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double")
    rows = rows.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in rows.columns])
    whole = {(r.a, r.b): r.corr for r in correlation.pearson_pairs(rows, rows.columns).collect()}
    monkeypatch.setattr(correlation, "BLOCK", 3)
    cut = {(r.a, r.b): r.corr for r in correlation.pearson_pairs(rows, rows.columns).collect()}
    assert len(whole) == 21 and cut == pytest.approx(whole)


def test_too_few_months_are_an_error(spark, rows):
    with pytest.raises(Exception, match="too few months"):
        folds.rolling_folds(rows, 5, 12, 3).collect()


def test_candidates_and_weights(spark, rows, monkeypatch):
    grid_of_two = [[0.0, 1.0], [0.3, 0.7], [0.5, 0.5], [1.0, 0.0], [0.9, 0.1]]
    grid = blend.simplex_grid(["a", "b", "c"], 20)
    assert len(grid) == 231 and all(sum(w) == pytest.approx(1) for w in grid)
    assert len(blend.simplex_grid(list("abcd"), 20)) == 1771
    assert len(blend.simplex_draws(list("abcde"))) == 500
    one = stream(rows).withColumn("q", 1 - F.col("p"))
    whole = {(r.month, r.candidate): r.composite for r in blend.score_candidates(one, ["p", "q"], grid_of_two).collect()}
    monkeypatch.setattr(blend, "BATCH", 2)
    assert {(r.month, r.candidate): r.composite for r in blend.score_candidates(one, ["p", "q"], grid_of_two).collect()} == pytest.approx(whole)
    got = blend.search_per_month(stream(rows).withColumn("q", 1 - F.col("p")).where("ref_date > '2000-10-01'"), ["p", "q"], rounds=1, draws=2)
    assert all(r.s == pytest.approx(1.0) for r in got.groupBy("month").agg(F.sum("w").alias("s")).collect())


def test_segment_weights_prefer_the_informative_stream(rows):
    s = stream(rows).withColumn("noise", F.rand(3)).withColumn("seg", F.col("cust_id") % 2)
    w = blend.segment_weights(s, ["p", "noise"], ["seg"])
    assert w["p"] > w["noise"] and sum(w.values()) == pytest.approx(1.0)


def test_fold_in_and_missing_models(spark):
    m = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))
    got = spark.range(1).select(blend.fold_in(m, "z", 0.2).alias("w"), blend.fold_in(m, "z", 0.0).alias("v")).first()
    assert got.w == {"a": pytest.approx(0.4), "b": pytest.approx(0.4), "z": pytest.approx(0.2)}
    assert got.v == {"a": 0.5, "b": 0.5}


def test_portfolio_blends_keep_rank_mode_apart():
    made = portfolio.blends([{"a": 1.0}], "z", (0.0, 0.1), (False, True))
    assert len(made) == 4 and {b.ranks for b in made} == {True, False}


def test_alignment(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1, 3)], "x int, z int")
    with pytest.raises(ValueError, match="missing in test \\['y'\\], extra in test \\['z'\\]"):
        quality.align(a, b)
    assert quality.align(a, b, "common")[0].columns == ["x"]
    assert quality.align(a, b, "zero")[1].first().y == 0.0


def test_output_check_flags_bad_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "cust_id long, churn double")
    assert not quality.output_check(df).first().valid
    with pytest.raises(ValueError):
        quality.output_check(df.drop("churn"))


def test_missing_table_names_the_places(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="data/raw"):
        tables.read_table(spark, str(tmp_path), "customers")


def test_submission_without_id_is_skipped(spark, tmp_path):
    (tmp_path / "submission_x.csv").write_text("id,target\n1,0.25\n")
    (tmp_path / "submission_y.csv").write_text("churn\n0.5\n")
    got = scores.read_submissions(spark, f"{tmp_path}/submission_*.csv").collect()
    assert [(r.model, r.cust_id, r.churn) for r in got] == [("x", "1", 0.25)]


def test_correlations_of_many_columns_take_one_pass(spark):
    """Gaps, a large offset, infinite and undefined values in more columns than one aggregate holds."""
    rng = np.random.default_rng(4)
    n, k = 400, 30
    x = rng.random((n, k)) + rng.random((n, 1)) * np.arange(k)
    x[:, 2], x[5, 3] = x[:, 2] + 1e6, np.inf
    gone = rng.random((n, k)) < 0.2
    gone[:, 6] = True
    rows = [[None if g else float(v) for v, g in zip(r, gs)] for r, gs in zip(x, gone)]
    rows[7][8] = float("nan")
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(r.a, r.b): r["corr"] for r in correlation.pearson_pairs(df, names).collect()}
    want = {(r.a, r.b): r["corr"] for i in range(0, k) for r in correlation._plain_pairs(df, [(names[i], c) for c in names[i + 1:]]).collect()}
    assert got.keys() == want.keys() and len(got) == k * (k - 1) // 2
    for pair, value in want.items():
        assert (got[pair] is None) == (value is None) and (value is None or got[pair] == pytest.approx(value, abs=1e-9)), pair
    assert want["c6", "c7"] is None and want["c3", "c9"] is None and want["c1", "c9"] is not None
