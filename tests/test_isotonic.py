"""Isotonic curves of many groups: against Spark's own fit, at the edges, saved and loaded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ebbtide.operators import isotonic
from ebbtide.plans import calibration, store


def scored(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 3)
    g = rng.choice(["x", "y", "z"], n, p=[0.7, 0.2, 0.1])
    y = (rng.random(n) < p**2).astype(int)
    pdf = pd.DataFrame({"cust_id": np.arange(n), "g": g, "p": p, "y": y, "fold": np.arange(n) % 4, "segment": np.where(g == "x", 0, np.where(g == "y", 1, 2))})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def spark_fit(df):
    pts = df.groupBy(F.col("p").alias("_p"), F.col("y").cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="_p", labelCol="y", weightCol="w", predictionCol="q").fit(pts)


def column(df, name="p"):
    return df.select("cust_id", name).toPandas().sort_values("cust_id")[name].to_numpy()


def test_curves_equal_sparks_fit_per_group(spark):
    _, df = scored(spark)
    curves = isotonic.fit_curves(calibration.points(df, by=["g"]))
    assert set(curves.places) == {"x", "y", "z"}
    for g in "xyz":
        mine = df.where(F.col("g") == g)
        probe = mine.unionByName(mine.withColumns({"p": F.col("p") * 1.3 - 0.1, "cust_id": F.col("cust_id") + 10_000}))
        want = column(spark_fit(mine).transform(probe.withColumnRenamed("p", "_p")), "q")
        assert column(probe.withColumn("p", curves.at(F.col("g"), F.col("p")))) == pytest.approx(want, abs=1e-9)
        assert (np.diff(curves.values[g][::2]) > 0).all()


def test_nothing_to_fit_on(spark):
    rows = spark.createDataFrame([("a", 0.1, 1.0, 1.0), (None, 0.2, 1.0, 1.0), ("b", None, 0.0, 1.0), ("c", 0.3, None, 1.0), ("d", float("nan"), 1.0, 1.0),
                                  ("e", 0.2, 1.0, 0.0)], "g string, p double, y double, w double")
    curves = isotonic.fit_curves(rows)
    assert set(curves.places) == {"a"}
    got = [r.q for r in spark.createDataFrame([("a", 5.0), ("a", None), (None, 0.1), ("q", 0.1)], "g string, p double").select(
        curves.at(F.col("g"), F.col("p")).alias("q")).collect()]
    assert got == [1.0, None, None, None]
    empty = isotonic.fit_curves(rows.where("false"))
    assert not empty.places and rows.select(empty.at(F.col("g"), F.col("p")).alias("q")).where("q IS NOT NULL").count() == 0


def test_folds_and_segments_in_one_job(spark):
    _, df = scored(spark)
    got = calibration.out_of_fold(df.withColumn("raw", F.col("p")), "fold", raw_share=0.25)
    for k in range(4):
        held = df.where(F.col("fold") == k)
        want = spark_fit(df.where(F.col("fold") != k)).transform(held.withColumnRenamed("p", "_p"))
        assert column(got.where(F.col("fold") == k)) == pytest.approx(column(want.withColumn("p", 0.75 * F.col("q") + 0.25 * F.col("_p"))), abs=1e-9)
    made = calibration.fit_segments(df, 3, min_rows=500)  # segment 2 is too small and takes the curve of all rows
    out = made.apply(df, raw_share=0.0)
    for s, rows in ((0, df.where("segment = 0")), (1, df.where("segment = 1")), (2, df)):
        want = spark_fit(rows).transform(df.where(F.col("segment") == s).withColumnRenamed("p", "_p"))
        assert column(out.where(F.col("segment") == s)) == pytest.approx(column(want, "q"), abs=1e-9)


def test_saved_curves(spark, tmp_path):
    _, df = scored(spark, 800)
    made = calibration.fit_segments(df, 3, min_rows=100)
    store.save_segments(spark, made, f"{tmp_path}/curves")
    again = store.load_segments(spark, f"{tmp_path}/curves")
    assert column(again.apply(df)) == pytest.approx(column(made.apply(df)), abs=0)


def test_null_folds_and_groups(spark):
    rows = spark.createDataFrame([(1, 0, None, 0.2, 0), (2, 1, None, 0.4, 1), (3, 0, "", 0.3, 1), (4, 1, "", 0.6, 0), (5, None, "", 0.5, 1), (6, 0, "only", 0.5, 1)],
                                 "cust_id int, fold int, area string, p double, y int")
    got = {r.cust_id: r.p for r in calibration.out_of_fold(rows, "fold", within=["area"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 6: None}
