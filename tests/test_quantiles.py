"""Percentiles of many columns equal numpy's, whatever the ranges."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import quantiles

PROBS = (0.0, 0.01, 0.2, 0.5, 0.77, 0.99, 1.0)


@pytest.mark.parametrize("ranges,sample", [(256, 4096), (7, 60), (3, 2)])
def test_percentiles_of_many_columns(spark, monkeypatch, ranges, sample):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame({
        "d": [None if i % 50 == 0 else dt.date(2000, 1 + i % 3, 1) for i in range(n)], "smooth": rng.normal(size=n), "tied": rng.integers(0, 4, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.9, -1.0, rng.random(n)), "one": 5.0, "zeros": np.where(rng.random(n) < 0.5, 0.0, -0.0), "huge": 10 ** rng.uniform(-300, 300, n)})
    pdf["part"] = pdf.smooth.where(rng.random(n) < 0.3)
    df = spark.createDataFrame(pdf).withColumn("part", F.when(~F.isnan("part"), F.col("part"))).withColumn("none", F.lit(None).cast("double"))
    df = df.withColumn("gap", F.when(F.month("d") == 2, F.col("smooth"))).repartition(5)
    names = ["smooth", "tied", "heavy", "one", "zeros", "huge", "part", "none", "gap"]
    got = {r.d: r for r in quantiles.column_percentiles(df, "d", {c: F.col(c) for c in names}, PROBS).collect()}
    want = df.toPandas()
    assert len(got) == 4
    for d, r in got.items():
        mine = want[want.d.isna() if d is None else want.d == d]
        for c in names:
            x = mine[c].dropna().astype(float)
            assert r[f"n:{c}"] == (len(x) or None)
            if len(x):
                assert r[f"q:{c}"] == pytest.approx(list(np.percentile(x, [100 * p for p in PROBS])), rel=1e-12, abs=1e-300)
            else:
                assert r[f"q:{c}"] is None


def test_without_rows_and_with_numbers_that_are_none(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", float("inf")), ("b", float("-inf")), ("b", 0.0)], "k string, x double")
    got = {r.k: r["q:x"] for r in quantiles.column_percentiles(df, "k", {"x": F.col("x")}, (0.0, 1.0)).collect()}
    assert got["a"][0] == 1.0 and math.isnan(got["a"][1]) and got["b"] == [float("-inf"), float("inf")]
    assert quantiles.column_percentiles(df.limit(0), "k", {"x": F.col("x")}, (0.5,)).collect() == []


def test_all_rows_as_one_group(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGES", 5)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", 20)
    x = np.concatenate([np.random.default_rng(4).normal(size=900), np.full(300, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("none", F.lit(None).cast("double")).repartition(4)
    got = quantiles.column_percentiles(df, None, {"x": F.col("x"), "none": F.col("none")}, PROBS)
    assert got.columns == ["q:x", "n:x", "q:none", "n:none"]
    row = got.first()
    assert row["q:x"] == pytest.approx(list(np.percentile(x, [100 * p for p in PROBS])), rel=1e-12) and row["n:x"] == 1200 and row["q:none"] is None
    assert quantiles.column_percentiles(df.limit(0), None, {"x": F.col("x")}, (0.5,)).collect() == []
