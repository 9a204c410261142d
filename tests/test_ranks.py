"""Distributed ranks, percentiles and metrics against brute force, on both paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import metrics, ranks


def frame(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": rng.choice(["x", "y"], n, p=[0.8, 0.2]),
        "id": rng.permutation(n),
        "p": np.round(rng.random(n), 2),
        "y": rng.integers(0, 2, n),
    })
    # One value holds a third of the rows.
    pdf.loc[rng.random(n) < 0.33, "p"] = 0.5
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("path", ["plain", "ranged"])
def test_average_rank_row_number_percentile(spark, path, request):
    if path == "ranged":
        request.getfixturevalue("ranged")
    pdf, df = frame(spark)
    assert (ranks._cuts(df.select("g", "p").distinct(), ["g"], "p") is None) == (path == "plain")
    got = ranks.average_ranks(df, ["g"], "p").toPandas().sort_values("id")
    want = pdf.sort_values("id").groupby("g")["p"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), want.to_numpy())
    rn = ranks.row_numbers(df, ["g"], [-F.col("p"), F.col("id")]).toPandas().sort_values("id")
    order = pdf.sort_values(["p", "id"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (rn["rn"].to_numpy() == order.loc[pdf.sort_values("id").index].to_numpy()).all()
    q = {r.g: list(r.q) for r in ranks.percentiles(df, ["g"], "p", (0, 0.01, 0.37, 0.5, 0.99, 1)).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(q[g], np.quantile(part["p"], (0, 0.01, 0.37, 0.5, 0.99, 1)))
    whole = ranks.percentiles(df, [], "p", (0.25,)).first().q
    assert np.allclose(whole, np.quantile(pdf["p"], 0.25))


def test_a_row_is_compared_with_few_cut_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    keys = [None, *np.round(rng.random(300), 3).tolist()]
    for size in (0, 1, 5, ranks.RANGES - 1, ranks.RANGES):
        cuts = sorted(np.round(rng.random(size), 3).tolist())
        df = spark.createDataFrame([(x, cuts) for x in keys], "x double, cuts array<double>").select("x", "cuts", F.struct("x").alias("k"))
        df = df.withColumn("structs", F.transform("cuts", lambda c: F.struct(c.alias("x"))))
        for cut, key, want in (("cuts", "x", [0, *np.searchsorted(cuts, keys[1:])]), ("structs", "k", None)):
            got = [r[0] for r in df.select(ranks._below(cut, key)).collect()]
            assert want is None or got == list(want)
            assert got == [r[0] for r in df.select(F.size(F.expr(f"filter({cut}, c -> c < {key})"))).collect()]
    # The rows are read for the sample and once more, whatever follows from their ranges.
    written = []
    monkeypatch.setattr(ranks, "SAMPLE_ONE_IN", 2)
    monkeypatch.setattr(ranks, "MIN_SAMPLED", 2)
    monkeypatch.setattr(ranks, "materialize", lambda d, keep=ranks.materialize: written.append(d.columns) or keep(d))
    rows = spark.range(200).select(F.lit(1).alias("g"), F.col("id").alias("x"), F.lit(1).cast("long").alias("n"))
    assert {(r.x, r.n_before) for r in ranks.running_totals(rows, ["g"], "x", ["n"]).collect()} == {(i, i) for i in range(200)}
    assert ["g", "x", "n", "_range"] in written


def brute(part, flip=False):
    part = part.sort_values("id")
    p, y = part["p"].to_numpy(), part["y"].to_numpy()
    r = pd.Series(p).rank(method="average").to_numpy()
    pos, neg = y.sum(), len(y) - y.sum()
    auc = (r[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    if flip and auc < 0.5:
        return brute(part.assign(p=1 - part["p"]))
    k = max(1, int(np.round(0.1 * len(y))))
    top = np.argsort(-p, kind="mergesort")[:k]
    return auc, y[top].sum() / pos, (y[top].sum() / k) / y.mean()


@pytest.mark.parametrize("path", ["plain", "ranged"])
@pytest.mark.parametrize("flip", [False, True])
def test_ranking_metrics(spark, path, flip, request):
    if path == "ranged":
        request.getfixturevalue("ranged")
    pdf, df = frame(spark, 3)
    got = {r.g: r for r in metrics.ranking_metrics(df, ["g"], ids=["id"], flip=flip).collect()}
    for g, part in pdf.groupby("g"):
        auc, recall, lift = brute(part, flip)
        assert got[g].auc == pytest.approx(auc)
        assert got[g].recall == pytest.approx(recall)
        assert got[g].lift == pytest.approx(lift)


def test_auc_of_reversed_score_is_the_complement(spark):
    _, df = frame(spark, 5)
    a = metrics.auc(df).first().auc
    b = metrics.auc(df.withColumn("p", 1 - F.col("p"))).first().auc
    assert a + b == pytest.approx(1.0)


def test_one_class_and_all_ties(spark):
    rows = [("one", i, 0.1 * i, 0) for i in range(5)] + [("tied", i, 0.5, i % 2) for i in range(10)]
    got = {r.g: r for r in metrics.ranking_metrics(
        spark.createDataFrame(rows, "g string, id long, p double, y int"), ["g"], ids=["id"]).collect()}
    assert got["one"].auc is None and got["one"].recall == 0.0 and got["one"].lift == 0.0
    assert got["tied"].auc == 0.5 and got["tied"].k == 1 and got["tied"].hits == 0


def test_rounding_of_the_top_share_is_half_even(spark):
    df = spark.createDataFrame([(i, i / 25, 1) for i in range(25)], "id long, p double, y int")
    assert metrics.ranking_metrics(df, ids=["id"]).first().k == 2
    assert metrics.ranking_metrics(df, ids=["id"], rounding="ceil").first().k == 3


def test_numbered_rows_are_worked_out_once(spark, ranged):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(500).mapInPandas(run, "id long")
    assert [r.rn for r in ranks.row_numbers(rows, [], [F.col("id")]).orderBy("id").collect()] == list(range(1, 501))
    assert read.value == 500
