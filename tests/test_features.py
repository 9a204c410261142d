"""Hand-worked rows for the cases where windows, gaps and cohort statistics are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbtide.features.build import feature_table
from ebbtide.features.demographics import demographics, fit_codes
from ebbtide.operators import quality

D = dt.date
H = "cust_id long, date date, mobile_eft_all_cnt double, mobile_eft_all_amt double, cc_transaction_all_amt double, " \
    "cc_transaction_all_cnt double, active_product_category_nbr double"
RAW = {"with_demographics": False, "winsorize": False, "relative": False, "sentinel": False}


def history(spark, rows):
    return spark.createDataFrame([(c, d, *(None if x is None else float(x) for x in v)) for c, d, *v in rows], H)


def people(spark, ids, tenure=10):
    return spark.createDataFrame(
        [(i, 30, tenure, "F", "north", "n/a", "a", "b") for i in ids],
        "cust_id long, age int, tenure int, gender string, province string, religion string, work_type string, work_sector string")


def cohort(spark, pairs):
    return spark.createDataFrame([(i, d, 0) for i, d in pairs], "cust_id long, ref_date date, churn int")


def one(spark, rows, ref, families, cust=1, **kw):
    ids = sorted({r[0] for r in rows})
    out = feature_table(history(spark, rows), people(spark, ids), cohort(spark, [(i, ref) for i in ids]), families, **{**RAW, **kw})
    return out.where(F.col("cust_id") == cust).first().asDict()


def test_window_borders(spark):
    ref = D(2000, 6, 1)
    rows = [(1, D(2000, 3, 1), 1, 10, 0, 0, 1), (1, D(2000, 3, 2), 1, 20, 0, 0, 1), (1, ref, 1, 40, 0, 0, 1),
            (1, D(2000, 6, 2), 1, 80, 0, 0, 9)]
    f = one(spark, rows, ref, ["windows", "performance"])
    assert f["mobile_eft_all_amt_sum_3m"] == 60  # the row on the far border is out, the one on the near border in
    assert f["active_months_3m"] == 2 and f["active_months_12m"] == 3
    assert f["activity_drop_ratio"] == 3.0  # here the far border day counts
    assert f["product_abandonment"] == 0.0


def test_month_end_reference_date(spark):
    rows = [(1, D(2000, 2, 29), 1, 5, 0, 0, 1), (1, D(2000, 3, 1), 1, 7, 0, 0, 1)]
    assert one(spark, rows, D(2000, 3, 31), ["windows"])["mobile_eft_all_amt_sum_1m"] == 7


def test_single_row_customer(spark):
    f = one(spark, [(1, D(2000, 5, 1), 1, 5, 0, 0, 3)], D(2000, 6, 1), ["windows", "trend", "patterns", "timing", "lifecycle", "performance"])
    assert f["mobile_eft_all_amt_std_12m"] is None and f["product_decline"] == 0
    assert f["mobile_eft_all_amt_trend_mean"] is None and f["time_avg_days_between_txn"] is None
    assert f["time_days_between_last_two_txn"] is None and f["balance_trend"] == 0 and f["txn_irregularity"] == 0
    assert f["lifecycle_activity_consistency"] is None  # one month seen: no sample deviation


def test_empty_windows_are_null_then_sentinel(spark):
    rows = [(1, D(1998, 5, 1), 1, 5, 0, 0, 3)]
    f = one(spark, rows, D(2000, 6, 1), ["windows", "behavior", "timing", "rfm"], relative=True)
    assert f["mobile_eft_all_amt_sum_12m"] is None and f["behavior_activity_trend"] is None
    assert f["time_consecutive_inactive_months"] is None and f["rfm_score"] is None and f["rfm_segment"] is None
    assert f["time_days_since_last_txn"] == 762
    g = one(spark, rows, D(2000, 6, 1), ["windows"], sentinel=True)
    assert g["mobile_eft_all_amt_sum_12m"] == -999 and g["active_months_1m"] == -999


def test_null_amount_with_count(spark):
    f = one(spark, [(1, D(2000, 5, 1), 2, None, 4, 1, 3)], D(2000, 6, 1), ["windows", "rfm"])
    assert f["mobile_eft_all_amt_sum_3m"] == 0 and f["mobile_eft_all_amt_mean_3m"] is None
    assert f["rfm_monetary_value"] == 4


def test_peak_month_takes_the_earliest_on_ties_and_the_partial_start_month(spark):
    rows = [(1, D(1999, 12, 1), 1, 1, 0, 0, 1), (1, D(1999, 12, 5), 1, 1, 0, 0, 1), (1, D(1999, 12, 9), 1, 1, 0, 0, 1),
            (1, D(2000, 2, 3), 1, 1, 0, 0, 1), (1, D(2000, 2, 9), 1, 1, 0, 0, 1)]
    f = one(spark, rows, D(2000, 6, 5), ["lifecycle", "timing"])
    # All time: December has three rows. Six months from 5 December: one row of it is left, February has two.
    assert f["time_days_since_peak_activity"] == (D(2000, 6, 5) - D(1999, 12, 1)).days
    assert f["lifecycle_days_since_peak"] == (D(2000, 6, 5) - D(2000, 2, 1)).days
    tie = one(spark, [r for r in rows if r[1] != D(2000, 2, 9)], D(2000, 6, 5), ["lifecycle"])
    assert tie["lifecycle_days_since_peak"] == (D(2000, 6, 5) - D(1999, 12, 1)).days


def test_constant_measure_has_no_score_and_is_lost(spark):
    rows = [(i, D(2000, 5, 1), 1, 5, 0, 0, 1) for i in range(1, 8)]
    f = one(spark, rows, D(2000, 6, 1), ["rfm"], relative=True)
    assert f["rfm_r_score"] is None and f["rfm_segment"] == "Lost" and f["rfm_score"] == pytest.approx(1.0)


def test_later_rows_and_row_order_change_nothing(spark):
    rows = [(c, D(2000, m, 1 + c), c, 10.0 * m, m, 1, m % 3) for c in (1, 2, 3) for m in range(1, 12)]
    ref = D(2000, 8, 1)
    ids = [1, 2, 3]
    fam = ["windows", "trend", "recency", "patterns", "deciles", "rfm", "behavior", "lifecycle", "timing", "performance", "risk"]

    def table(part):
        out = feature_table(history(spark, part), people(spark, ids), cohort(spark, [(i, ref) for i in ids]), fam,
                            with_demographics=False)
        return sorted(map(tuple, out.collect()))

    past = [r for r in rows if r[1] <= ref]
    assert table(rows) == table(past) == table(past[::-1])


def test_same_day_rows_are_merged(spark):
    rows = [(1, D(2000, 5, 1), 1, 5, 0, 0, 1), (1, D(2000, 5, 1), 2, 7, 1, 1, 4)]
    f = one(spark, rows, D(2000, 6, 1), ["windows"])
    assert f["active_months_3m"] == 1 and f["mobile_eft_all_amt_sum_3m"] == 12
    assert f["active_product_category_nbr_max_3m"] == 4


def test_demographics_zero_tenure_and_unseen_category(spark):
    train = people(spark, [1, 2]).withColumn("tenure", F.when(F.col("cust_id") == 1, 0).otherwise(24))
    codes = fit_codes(train)
    got = {r.cust_id: r for r in demographics(train, codes).collect()}
    assert {got[1].tenure_group_encoded, got[2].tenure_group_encoded} == {0, 1}  # "1-3y" sorts before "nan"
    assert got[1].tenure_group_encoded == 1
    unseen = demographics(people(spark, [3]).withColumn("province", F.lit("south")), codes).first()
    assert unseen.province_encoded == 1


def test_full_table_has_every_named_column(spark):
    rows = [(c, D(2000, m, 1), 1, 2, 3, 1, 1) for c in range(1, 4) for m in range(1, 6)]
    t = feature_table(history(spark, rows), people(spark, [1, 2, 3]), cohort(spark, [(i, D(2000, 6, 1)) for i in (1, 2, 3)]))
    assert len(t.columns) == 2 + 285
    assert len(set(t.columns)) == len(t.columns)
    nulls = t.select([F.count_if(F.col(c).isNull()).alias(c) for c in t.columns]).first().asDict()
    assert not any(nulls.values())


def test_future_leak_validator(spark):
    df = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 2, 1),)], "date date")
    quality.assert_no_future(df, F.lit("2000-02-01"), inclusive=False)
    with pytest.raises(ValueError, match="n=1"):
        quality.assert_no_future(df, F.lit("2000-02-01"))


def test_tasks_of_the_panel_follow_its_rows(spark, monkeypatch):
    """The join and what comes after it are dealt to tasks by rows, however few bytes are shuffled."""
    import datetime

    from ebbtide.features import panel
    from ebbtide.runtime import materialize

    day = datetime.date(2000, 1, 1)
    h = spark.createDataFrame([(i, day, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(300)], "cust_id long, date date, " + ", ".join(f"{c} double" for c in panel.MEASURES))
    c = spark.createDataFrame([(i, datetime.date(2000, 2, 1)) for i in range(300)], "cust_id long, ref_date date")
    monkeypatch.setattr(panel, "ROWS_PER_TASK", 20)
    h, c = materialize(h), materialize(c)
    tasks = panel.tasks_for(c, h)
    joined = panel.point_in_time(h, c, tasks=tasks)
    assert tasks == 30 and joined.rdd.getNumPartitions() == 30
    a = panel.Aggregates()
    total = a.sum(panel.EFT_AMT, "3")
    got = panel.aggregate(joined, a).select(total.alias("s"))
    assert got.rdd.getNumPartitions() == 30 and [r.s for r in got.collect()] == [2.0] * 300
