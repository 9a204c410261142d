"""Readers and writers, cleaning, alignment, interactions, importance, drift statistics (A, B, C, F, G, H rows)."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.features import PIT, G, W1, W12, full_features, n, rounded, table
from checks.registry import BASE, CUSTOMERS_SQL, cohort, customers, history, query
from checks.streams import ABC, IDS, S, long_streams, metric_ctes, rnd, streams
from ebbtide.features import interactions
from ebbtide.features.build import model_matrix
from ebbtide.features.panel import KEYS
from ebbtide.functions import periods, safe
from ebbtide.operators import importance, quality
from ebbtide.runtime import materialize, scratch_dir
from ebbtide.sources import adapters, scores, tables


def fresh(spark) -> str:
    return f"{scratch_dir(spark)}/ebbtide/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- A: readers and writers


@query("a1_csv_scan", f"WITH {CUSTOMERS_SQL.strip()} SELECT cust_id, gender, age, province, religion, work_type, work_sector, tenure FROM customers")
def a1_csv_scan(spark, path):
    root = fresh(spark)
    customers(spark, path).write.option("header", True).csv(f"{root}/data/raw/customers.csv")
    return tables.read_table(spark, root, "customers")


@query("a2_model_files", f"{S} SELECT model, cust_id, ref_date, p FROM l")
def a2_model_files(spark, path):
    root, wide = fresh(spark), materialize(streams(spark, path))
    for m in ABC:
        wide.select(*IDS, F.col(m).alias("p")).write.parquet(f"{root}/{m}.parquet")
    return scores.read_model_files(spark, root)


def _write_submissions(spark, path) -> str:
    root, wide = fresh(spark), materialize(streams(spark, path, adapters.SCORE_DATES[1:]))
    names = {"a": ("cust_id", "churn"), "b": ("ID", "target"), "c": ("score", "customer_id")}
    for m in ABC:
        first, second = names[m]
        cols = {first: F.col("cust_id"), second: F.col(m)} if m != "c" else {first: F.col(m), second: F.col("cust_id")}
        wide.select(*[c.alias(k) for k, c in cols.items()]).write.option("header", True).csv(f"{root}/submission_{m}.csv")
    wide.select(F.col("a").alias("churn")).write.option("header", True).csv(f"{root}/submission_broken.csv")
    return root


DEC = "ref_date = DATE '2000-12-01'"


@query("a3_submission_glob", f"{S} SELECT model, CAST(cust_id AS VARCHAR) AS cust_id, p AS churn FROM l WHERE {DEC}")
def a3_submission_glob(spark, path):
    return scores.read_submissions(spark, f"{_write_submissions(spark, path)}/submission_*.csv")


query("a4_normalised_names", "SELECT CAST(c_custkey AS VARCHAR) AS cust_id, c_acctbal AS churn FROM customer")(
    lambda s, p: scores.normalise_names(adapters.table(s, p, "customer").select(
        F.col("c_custkey").alias("Customer_ID"), F.col("c_acctbal").alias("Score"))))


@query("c9_align_to_ids", f"{S} SELECT CAST(ids.cust_id AS VARCHAR) AS cust_id, a, b FROM (SELECT DISTINCT c_custkey AS cust_id FROM customer) ids "
       f"LEFT JOIN (SELECT cust_id, a, b FROM s WHERE {DEC}) z ON z.cust_id = ids.cust_id")
def c9_align_to_ids(spark, path):
    long = scores.read_submissions(spark, f"{_write_submissions(spark, path)}/submission_*.csv")
    return scores.align_to(customers(spark, path), long, ["a", "b"])


# Importance tables derived from the data: the share of a brand's parts in a size class plays the gain.
IMP_SQL = ("imp AS (SELECT 'days_' || p_brand AS feature, CAST(p_size % 4 AS VARCHAR) AS fold, CAST(count(*) AS DOUBLE) AS gain "
           "FROM part GROUP BY ALL), pv AS (SELECT feature, " + ", ".join(
               f"coalesce(sum(gain) FILTER (WHERE fold = '{f}'), 0.0) AS f{f}" for f in range(4)) + " FROM imp GROUP BY feature)")
FOLDS = [str(f) for f in range(4)]


def gains(spark, path) -> DataFrame:
    return adapters.table(spark, path, "part").groupBy(
        F.concat(F.lit("days_"), "p_brand").alias("feature"), (F.col("p_size") % 4).cast("string").alias("fold")
    ).agg(F.count(F.lit(1)).cast("double").alias("gain"))


@query("a5_importance_glob", f"WITH {IMP_SQL} SELECT 'feature_importance_' || fold AS source, fold AS model, feature, gain AS importance FROM imp")
def a5_importance_glob(spark, path):
    root, g = fresh(spark), materialize(gains(spark, path))
    for f in FOLDS:
        g.where(F.col("fold") == f).select("feature", F.col("gain").alias("importance_mean")).write.option(
            "header", True).csv(f"{root}/feature_importance_{f}.csv")
    return scores.read_importance(spark, f"{root}/feature_importance*.csv")


def _with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("ref_date") >= "2000-11-01", "test").otherwise("oof"))


@query("a7_bundle_pruned_read", f"{S} SELECT model, count(*) AS n, round(sum(p), 6) + 0.0 AS total FROM l WHERE ref_date >= '2000-11-01' AND model IN ('a', 'c') GROUP BY model")
def a7_bundle_pruned_read(spark, path):
    root = fresh(spark)
    scores.write_bundle(_with_split(long_streams(spark, path)), root)
    got = scores.read_bundle(spark, root, "test", ["a", "c"])
    return rnd(got.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")))


@query("a6_scored_output", f"{S} SELECT cust_id, a AS churn FROM s WHERE {DEC}")
def a6_scored_output(spark, path):
    root = fresh(spark)
    one = streams(spark, path, adapters.SCORE_DATES[1:]).select("cust_id", F.col("a").alias("churn"))
    tables.write_scores(one, root)
    return spark.read.option("header", True).schema("cust_id bigint, churn double").csv(root)


@query("a8_matrix_cache", f"{PIT} SELECT cust_id, ref_date, coalesce(CAST({n(W12)} AS DOUBLE), -999) AS rfm_frequency_count FROM j {G}")
def a8_matrix_cache(spark, path):
    root = fresh(spark)
    tables.write_matrix(table(spark, path, ["recency", "rfm"], sentinel=True), root)
    return tables.read_matrix(spark, root).select(*KEYS, "rfm_frequency_count")


@query("a9_report", f"{S} SELECT model AS feature, count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS nulls, round(avg(p), 6) + 0.0 AS mean, "
       "round(stddev_samp(p), 6) + 0.0 AS std, round(var_samp(p), 6) + 0.0 AS variance FROM l GROUP BY model")
def a9_report(spark, path):
    root = fresh(spark)
    tables.write_report(quality.profile(streams(spark, path), ABC), root)
    return rnd(spark.read.json(root))


query("a10_output_check", f"{S} SELECT count(*) AS rows, count(*) FILTER (WHERE cust_id IS NULL OR a IS NULL) AS nulls, min(a) AS min_score, max(a) AS max_score, "
      "count(*) FILTER (WHERE a IS NULL) = 0 AND min(a) >= 0 AND max(a) <= 1 AS valid FROM s")(
    lambda s, p: quality.output_check(streams(s, p).withColumn("churn", F.col("a"))))
query("a11_attach_ids", f"{S} SELECT c.cust_id, c.ref_date, s.a FROM cohort c LEFT JOIN (SELECT * FROM s WHERE a > 0.5) s USING (cust_id, ref_date)")(
    lambda s, p: scores.attach_ids(streams(s, p).where("a > 0.5").select(*IDS, "a"), cohort(s, p)))

# ---------------------------------------------------------------- B: projections and cleaning

DIRTY_SQL = ("WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'NaN'::DOUBLE "
             "WHEN o_orderkey % 7 = 2 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 7 = 3 THEN '-Infinity'::DOUBLE ELSE floor(o_totalprice) END AS x, "
             "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS t FROM orders)")


def dirty(spark, path) -> DataFrame:
    k = F.col("o_orderkey")
    x = F.when(k % 7 == 0, None)
    for i, v in ((1, "nan"), (2, "inf"), (3, "-inf")):
        x = x.when(k % 7 == i, F.lit(float(v)))
    text = F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(k.cast("string"))
    return adapters.table(spark, path, "orders").select(k.alias("id"), x.otherwise(F.floor("o_totalprice").cast("double")).alias("x"), text.alias("t"))


query("b4_bounded_window", f"{PIT} SELECT cust_id, ref_date, CAST(count(*) AS DOUBLE) AS n FROM j WHERE {W12} GROUP BY cust_id, ref_date")(
    lambda s, p: table(s, p, ["rfm"]).where("rfm_frequency_count is not null").select(*KEYS, F.col("rfm_frequency_count").cast("double").alias("n")))
query("b6_numeric_matrix", f"WITH {CUSTOMERS_SQL.strip()} SELECT cust_id, age, tenure FROM customers")(
    lambda s, p: model_matrix(customers(s, p)).select("cust_id", *quality.numeric_columns(customers(s, p))))
query("b7_without_sensitive", f"WITH {CUSTOMERS_SQL.strip()} SELECT * EXCLUDE (religion) FROM customers")(
    lambda s, p: quality.drop_like(customers(s, p)))
query("b8_zero_filled_alignment", f"{S} SELECT cust_id, ref_date, a, CAST(0.0 AS DOUBLE) AS extra FROM s")(
    lambda s, p: quality.align(streams(s, p).select(*IDS, "a", F.lit(1.0).alias("extra")), streams(s, p).select("a", *IDS), "zero")[1])
query("b9_sentinel_fill", f"{DIRTY_SQL} SELECT id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN -999.0 ELSE x END AS x FROM d")(
    lambda s, p: dirty(s, p).select("id", safe.fill(F.col("x")).alias("x")))
query("b10_coerce", f"{DIRTY_SQL} SELECT id, coalesce(TRY_CAST(t AS DOUBLE), 0) AS t FROM d")(
    lambda s, p: dirty(s, p).select("id", safe.coerce(F.col("t")).alias("t")))
query("b11_infinite_fill", f"{DIRTY_SQL} SELECT id, CASE WHEN isnan(x) THEN NULL WHEN isinf(x) THEN -999.0 ELSE x END AS x FROM d")(
    lambda s, p: dirty(s, p).select("id", F.nanvl(safe.fill_infinite(F.col("x")), F.lit(None)).alias("x")))
query("b12_row_sample", f"{BASE} SELECT cust_id, ref_date, churn FROM cohort ORDER BY md5(concat_ws('-', CAST(cust_id AS VARCHAR), CAST(ref_date AS VARCHAR), '42')), "
      "cust_id, ref_date LIMIT 1000")(
    lambda s, p: quality.sample_rows(cohort(s, p), IDS, 1000))

# ---------------------------------------------------------------- C, F: joins and sets

query("c5_family_left_join", f"{PIT} SELECT cust_id, ref_date, CAST({n(W1)} AS DOUBLE) AS n1, CAST({n(W12)} AS DOUBLE) AS n12 FROM j {G}")(
    lambda s, p: table(s, p, ["timing"]).select(*KEYS, F.col("time_txn_count_last_1m").cast("double").alias("n1")).join(
        table(s, p, ["rfm"]).select(*KEYS, F.col("rfm_frequency_count").cast("double").alias("n12")), KEYS, "left"))
query("c10_fold_importance", f"WITH {IMP_SQL} SELECT feature, " + ", ".join(f"f{f} AS importance_fold_{f}" for f in FOLDS)
      + ", (f0 + f1 + f2 + f3) / 4 AS importance_mean, round(list_stddev_samp([f0, f1, f2, f3]), 6) + 0.0 AS importance_std FROM pv")(
    lambda s, p: rnd(importance.across_folds(gains(s, p), FOLDS)))
query("d42_importance_std", f"WITH {IMP_SQL} SELECT feature, (f0 + f1 + f2 + f3) / 4 AS importance_mean, round(list_stddev_samp([f0, f1, f2, f3]), 6) + 0.0 "
      "AS importance_std FROM pv")(
    lambda s, p: rnd(importance.across_folds(gains(s, p), FOLDS)).select("feature", "importance_mean", "importance_std"))
ROLL = (f"WITH {IMP_SQL}, ro AS (SELECT feature, avg(gain) AS importance_mean, stddev_samp(gain) AS importance_std, min(gain) AS importance_min, "
        "max(gain) AS importance_max, count(gain) AS num_models, avg(gain) / (stddev_samp(gain) + 1e-6) AS consistency FROM imp GROUP BY feature), "
        "rr AS (SELECT *, CAST(row_number() OVER (ORDER BY importance_mean DESC, feature) AS INTEGER) AS rank FROM ro)")


def rolled(spark, path, method="mean") -> DataFrame:
    return importance.roll_up(gains(spark, path).withColumnRenamed("gain", "importance"), method)


query("d41_importance_roll_up", f"{ROLL} SELECT feature, round(importance_mean, 6) + 0.0 AS importance_mean, round(importance_std, 6) + 0.0 AS importance_std, "
      "importance_min, importance_max, num_models, round(consistency, 3) + 0.0 AS consistency, rank FROM rr")(
    lambda s, p: rnd(rolled(s, p)).withColumn("consistency", F.round("consistency", 3) + F.lit(0.0)))
query("g13_consistency_level", f"{ROLL} SELECT feature, CASE WHEN importance_std / (importance_mean + 1e-6) < 0.2 THEN 'Very Consistent' WHEN importance_std / "
      "(importance_mean + 1e-6) < 0.5 THEN 'Consistent' WHEN importance_std / (importance_mean + 1e-6) < 1.0 THEN 'Moderate' ELSE 'Inconsistent' END AS level FROM rr")(
    lambda s, p: rolled(s, p).select("feature", importance.consistency_level(F.col("importance_std"), F.col("importance_mean")).alias("level")))
query("i13_category_share", f"{ROLL} SELECT 'time_based' AS category, count(*) AS features, round(count(*) / 10.0 * 100, 6) + 0.0 AS pct FROM rr WHERE rank <= 10")(
    lambda s, p: rnd(importance.category_share(rolled(s, p), 10)))
query("g11_top_features", f"{ROLL} SELECT feature, round(importance_mean, 6) + 0.0 AS importance_mean FROM rr WHERE rank <= 8")(
    lambda s, p: rnd(interactions.top_features(rolled(s, p)).select("feature", "importance_mean")))
query("c12_feature_pairs", f"{ROLL} SELECT x.feature AS a, y.feature AS b FROM rr x JOIN rr y ON x.rank < y.rank")(
    lambda s, p: importance.feature_pairs(rolled(s, p)))
# Names built from the data: every third feature is an interaction of two brands.
NAMES = (f"{ROLL}, nm AS (SELECT CASE WHEN rank % 3 = 0 THEN feature || '_X_' || (SELECT min(feature) FROM rr) ELSE feature END AS feature, importance_mean, rank FROM rr), "
         "bs AS (SELECT * FROM nm WHERE rank <= 20 AND lower(feature) NOT LIKE '%\\_x\\_%' ESCAPE '\\' ORDER BY rank LIMIT 10), "
         "pr AS (SELECT x.feature AS a, y.feature AS b, least(lower(x.feature), lower(y.feature)) AS lo, greatest(lower(x.feature), lower(y.feature)) AS hi "
         "FROM bs x JOIN bs y ON x.rank < y.rank), ex AS (SELECT least(split_part(lower(feature), '_x_', 1), split_part(lower(feature), '_x_', 2)) AS lo, "
         "greatest(split_part(lower(feature), '_x_', 1), split_part(lower(feature), '_x_', 2)) AS hi FROM nm WHERE lower(feature) LIKE '%\\_x\\_%' ESCAPE '\\')")


def named(spark, path) -> DataFrame:
    r = rolled(spark, path)
    cross = F.concat("feature", F.lit("_X_"), r.agg(F.min("feature")).scalar())
    return r.select(
        F.when(F.col("rank") % 3 == 0, cross).otherwise(F.col("feature")).alias("feature"), "importance_mean", "rank")


query("i12_new_interactions", f"{NAMES} SELECT a, b FROM pr WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.lo = pr.lo AND ex.hi = pr.hi)")(
    lambda s, p: importance.new_interactions(named(s, p)))
query("f4_pair_difference", f"{NAMES} SELECT lo AS x, hi AS y FROM pr EXCEPT SELECT lo, hi FROM ex")(
    lambda s, p: importance.new_interactions(named(s, p)).select(
        F.least(F.lower("a"), F.lower("b")).alias("x"), F.greatest(F.lower("a"), F.lower("b")).alias("y")).distinct())
query("j16_stable_features", f"WITH {IMP_SQL}, t AS (SELECT fold, sum(gain) AS t FROM imp GROUP BY fold), g AS (SELECT feature, gain / (t + 1e-9) AS g FROM imp JOIN t USING (fold)), "
      "a AS (SELECT feature, sum(CASE WHEN g > 0.001 THEN 1 ELSE 0 END) / 4.0 AS presence, sum(g) / 4 AS mean_gain, sqrt(greatest(sum(g * g) / 4 - (sum(g) / 4) ** 2, 0)) "
      "AS std_gain FROM g GROUP BY feature) SELECT feature, round(presence, 6) + 0.0 AS presence, round(mean_gain, 6) + 0.0 AS mean_gain, round(std_gain, 6) + 0.0 AS std_gain, "
      "presence >= 0.7 AND std_gain / (mean_gain + 1e-9) < 1 AND mean_gain > 0.001 AS stable FROM a")(
    lambda s, p: rnd(importance.stable_features(gains(s, p).withColumnRenamed("fold", "split"))).drop("cv"))

# ---------------------------------------------------------------- numeric features: drift, correlation, interactions

NUM = ["rfm_recency_days", "rfm_frequency_count", "rfm_monetary_value", "rfm_recency_exp_weighted"]
NUM_SQL = (f"{PIT}, f AS (SELECT cust_id, ref_date, coalesce(CAST(date_diff('day', max(date) FILTER (WHERE {W12}), ref_date) AS DOUBLE), -999) AS rfm_recency_days, "
           f"coalesce(CAST({n(W12)} AS DOUBLE), -999) AS rfm_frequency_count, coalesce(sum(total_amt) FILTER (WHERE {W12}), -999) AS rfm_monetary_value, "
           f"coalesce(sum(exp(-date_diff('day', date, ref_date) / 45.0)) FILTER (WHERE {W12}), -999) AS rfm_recency_exp_weighted FROM j {G}), "
           "x AS (SELECT f.*, c.churn, CASE WHEN f.ref_date >= '2000-11-01' THEN 1 ELSE 0 END AS domain FROM f JOIN cohort c USING (cust_id, ref_date))")
LONG_SQL = "lg AS (" + " UNION ALL ".join(f"SELECT domain, churn, '{c}' AS feature, {c} AS v FROM x" for c in NUM) + ")"


def numeric(spark, path) -> DataFrame:
    f = table(spark, path, ["rfm"], sentinel=True).select(*KEYS, *NUM)
    return f.join(cohort(spark, path), KEYS)


def sides(spark, path):
    x = materialize(numeric(spark, path))
    return x.where("ref_date < '2000-11-01'"), x.where("ref_date >= '2000-11-01'")


query("d40_mean_shift", f"{NUM_SQL}, {LONG_SQL} SELECT feature, round(abs(avg(v) FILTER (WHERE domain = 0) - avg(v) FILTER (WHERE domain = 1)) / "
      "(stddev_samp(v) FILTER (WHERE domain = 0) + stddev_samp(v) FILTER (WHERE domain = 1)), 6) + 0.0 AS shift FROM lg GROUP BY feature")(
    lambda s, p: rnd(quality.mean_shift(*sides(s, p), NUM)))
query("d43_variance_ranking", f"{NUM_SQL}, {LONG_SQL}, v AS (SELECT feature, var_samp(v) AS v FROM lg GROUP BY feature) SELECT feature FROM v ORDER BY v DESC, feature LIMIT 2")(
    lambda s, p: interactions.top_by_variance(quality.profile(numeric(s, p), NUM), 2).select("feature"))
query("d44_label_summary", f"{BASE} SELECT round(avg(churn), 6) + 0.0 AS prevalence, count(*) FILTER (WHERE churn IS NULL) AS missing_labels FROM cohort")(
    lambda s, p: rnd(quality.label_summary(cohort(s, p))))
query("f2_domain_union", f"{NUM_SQL} SELECT cust_id, ref_date, CAST(domain AS INTEGER) AS domain FROM x")(
    lambda s, p: quality.with_split(*sides(s, p)).select(*KEYS, "domain"))
query("f1_union_of_dates", f"{NUM_SQL} SELECT cust_id, ref_date, rfm_frequency_count FROM x")(lambda s, p: sides(s, p)[0].unionByName(sides(s, p)[1]).select(*KEYS, "rfm_frequency_count"))
query("h12_leakage_report", f"{NUM_SQL}, {LONG_SQL}, z AS (SELECT feature, corr(v, churn) FILTER (WHERE domain = 0) AS label_corr, "
      "abs(avg(v) FILTER (WHERE domain = 1) - avg(v) FILTER (WHERE domain = 0)) / stddev_samp(v) FILTER (WHERE domain = 0) AS shift FROM lg GROUP BY feature) "
      "SELECT feature, round(label_corr, 6) + 0.0 AS label_corr, round(shift, 6) + 0.0 AS shift, CAST(0 AS DOUBLE) AS null_gap, false AS suspicious, "
      "abs(label_corr) > 0.9 OR shift > 3 AS flagged FROM z")(
    lambda s, p: rnd(quality.leakage_report(*sides(s, p), NUM)))
query("h10_future_rows", f"{PIT} SELECT 'date' AS \"column\", count(*) FILTER (WHERE date >= ref_date) AS violations, max(date) AS max_seen FROM j")(
    lambda s, p: quality.future_rows(_joined(s, p), F.col("ref_date"), ["date"]))
query("h11_window_guard", f"{PIT} SELECT count(*) FILTER (WHERE date > ref_date) AS violations FROM j")(
    lambda s, p: quality.future_rows(_joined(s, p), F.col("ref_date"), ["date"], inclusive=False).select("violations"))


def _joined(spark, path) -> DataFrame:
    from ebbtide.features.panel import point_in_time

    return point_in_time(history(spark, path), cohort(spark, path), horizon=None).where("date is not null")


query("h14_domain_weights", f"{S} SELECT cust_id, ref_date, round(greatest(least(1 / (1 + exp(2.0 * (a - 0.5))), 1.2), 0.8), 6) + 0.0 AS w, "
      "round(greatest(least(1 - a, 1.1), 0.9), 6) + 0.0 AS w2 FROM s")(
    lambda s, p: rnd(streams(s, p).select(*IDS, quality.domain_weight(F.col("a")).alias("w"), quality.domain_weight(F.col("a"), "complement").alias("w2"))))
query("h15_year_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998")(
    lambda s, p: quality.in_years(adapters.table(s, p, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), 1997, 1998, "d"))
PAIR6 = list(combinations(NUM, 2))


def _red():
    from ebbtide.operators import correlation

    return correlation


query("i10_redundant_pairs", f"{NUM_SQL}, pc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM x" for a, b in PAIR6)
      + ") SELECT a, b, round(corr, 6) + 0.0 AS corr FROM pc WHERE abs(corr) >= 0.5")(
    lambda s, p: rnd(_red().redundant_pairs(_red().pearson_pairs(numeric(s, p), NUM), 0.5)))
@query("i11_removal_list", f"{NUM_SQL}, {LONG_SQL}, im AS (SELECT feature, abs(corr(v, churn)) AS im FROM lg GROUP BY feature), pc AS ("
      + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM x" for a, b in PAIR6)
      + ") SELECT CASE WHEN i.im < k.im THEN a ELSE b END AS feature FROM pc JOIN im i ON i.feature = a JOIN im k ON k.feature = b WHERE abs(corr) >= 0.5 "
      "UNION SELECT feature FROM im WHERE im < 0.001")
def i11_removal_list(spark, path):
    x = materialize(numeric(spark, path))
    imp = quality.long_form(x, NUM, ["churn"]).groupBy("feature").agg(F.abs(F.corr("x", "churn")).alias("importance_mean"))
    pairs = _red().redundant_pairs(_red().pearson_pairs(x, NUM), 0.5)
    return importance.removal_list(pairs, imp)


A, B = "rfm_recency_days", "rfm_frequency_count"
query("g10_interactions", f"{NUM_SQL} SELECT cust_id, ref_date, {A} * {B} AS {A}_X_{B}, {A} + {B} AS {A}_PLUS_{B}, {A} - {B} AS {A}_MINUS_{B}, {B} - {A} AS {B}_MINUS_{A}, "
      f"round(CASE WHEN abs({B}) > 1e-9 THEN {A} / {B} ELSE -999 END, 6) + 0.0 AS {A}_DIV_{B}, round(CASE WHEN abs({A}) > 1e-9 THEN {B} / {A} ELSE -999 END, 6) + 0.0 "
      f"AS {B}_DIV_{A} FROM x")(
    lambda s, p: rnd(interactions.cross(numeric(s, p).select(*KEYS, A, B), [A, B]).drop(A, B)))
query("g10_simple_interactions", f"{NUM_SQL} SELECT cust_id, ref_date, {A} * {B} AS {A}_X_{B}, round({A} / nullif({B} + 1, 0), 6) + 0.0 AS {A}_DIV_{B}, "
      f"round({B} / nullif({A} + 1, 0), 6) + 0.0 AS {B}_DIV_{A} FROM x")(
    lambda s, p: rnd(interactions.cross_simple(numeric(s, p).select(*KEYS, A, B), [A, B]).drop(A, B)))

# ---------------------------------------------------------------- G: scalar functions

query("g1_month_offset", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS m1, CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS m12 FROM orders")(
    lambda s, p: adapters.table(s, p, "orders").select("o_orderkey", *[periods.back(F.col("o_orderdate").cast("date"), m).alias(f"m{m}") for m in (1, 12)]))
query("g2_month_border_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, last_day(CAST(o_orderdate AS DATE)) AS last_day FROM orders")(
    lambda s, p: adapters.table(s, p, "orders").select("o_orderkey", periods.month_start(F.col("o_orderdate")).alias("first_day"), periods.month_end(F.col("o_orderdate")).alias("last_day")))
@query("g3_differences", "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, (year(l_shipdate) * 12 + month(l_shipdate)) - "
      "(year(o_orderdate) * 12 + month(o_orderdate)) AS months FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def g3_differences(spark, path):
    j = adapters.table(spark, path, "lineitem").join(adapters.table(spark, path, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"),
                    (periods.month_number(F.col("l_shipdate")) - periods.month_number(F.col("o_orderdate"))).cast("long").alias("months"))


query("g4_month_sequence", "SELECT o_orderkey, CAST(unnest(generate_series(CAST(date_trunc('month', o_orderdate) AS DATE) - INTERVAL 5 MONTH, date_trunc('month', o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS m FROM orders")(
    lambda s, p: adapters.table(s, p, "orders").select("o_orderkey", F.explode(periods.month_range(F.add_months("o_orderdate", -5), F.col("o_orderdate"))).alias("m")))
query("g6_safe_division", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) + 0.0 AS a, round(CASE WHEN abs(l_tax) > 1e-9 THEN l_quantity / l_tax END, 6) + 0.0 AS b, "
      "round(l_quantity / (l_discount + 1), 6) + 0.0 AS c FROM lineitem")(
    lambda s, p: adapters.table(s, p, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.round(safe.ratio(F.col("l_extendedprice"), F.col("l_discount")), 4) + F.lit(0.0)).alias("a"),
        (F.round(safe.guarded_ratio(F.col("l_quantity"), F.col("l_tax")), 6) + F.lit(0.0)).alias("b"),
        (F.round(safe.shifted_ratio(F.col("l_quantity"), F.col("l_discount")), 6) + F.lit(0.0)).alias("c")))
query("g7_transforms", f"{S} SELECT cust_id, ref_date, round(ln(q / (1 - q)), 6) + 0.0 AS z, round(1 / (1 + exp(-a)), 6) + 0.0 AS g, round(pow(q, 1.3), 6) + 0.0 AS w "
      "FROM (SELECT *, greatest(least(a, 1 - 1e-6), 1e-6) AS q FROM s)")(
    lambda s, p: rnd(streams(s, p).select(*IDS, safe.logit(F.col("a")).alias("z"), safe.sigmoid(F.col("a")).alias("g"),
                                          F.pow(safe.clip(F.col("a"), 1e-6, 1 - 1e-6), F.lit(1.3)).alias("w"))))
# Feature names built from part types, so that every class of the name rules is met.
PART_NAMES = "lower(replace(p_type, ' ', '_')) || CASE p_size % 9 WHEN 0 THEN '_X_a' WHEN 1 THEN '_per_b' WHEN 2 THEN '_recency' WHEN 3 THEN '_delta_c' WHEN 4 THEN '_tenure' WHEN 5 THEN '_days_d' WHEN 6 THEN '_mean' WHEN 7 THEN '_decay' ELSE '_next_e' END"


def part_names(spark, path) -> DataFrame:
    tails = ("_X_a", "_per_b", "_recency", "_delta_c", "_tenure", "_days_d", "_mean", "_decay", "_next_e")
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), F.col("p_size") % 9 + 1)
    name = F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), tail)
    return adapters.table(spark, path, "part").select("p_partkey", name.alias("feature"))


query("g12_name_category", f"WITH f AS (SELECT p_partkey, {PART_NAMES} AS feature FROM part) SELECT p_partkey, CASE " + " ".join(
    f"WHEN regexp_matches(lower(feature), '{pat}') THEN '{lab}'" for lab, pat in importance.CATEGORIES) + " ELSE 'basic' END AS category FROM f")(
    lambda s, p: part_names(s, p).select("p_partkey", importance.category(F.col("feature")).alias("category")))
query("g14_suspicious_names", f"WITH f AS (SELECT p_partkey, {PART_NAMES} AS feature FROM part) SELECT p_partkey, feature LIKE '%\\_next\\_%' ESCAPE '\\' AS suspicious FROM f")(
    lambda s, p: part_names(s, p).select("p_partkey", quality.suspicious_name(F.col("feature")).alias("suspicious")))
FILES = "CASE p_size % 3 WHEN 0 THEN 'submission_cal_ensemble_isotonic_g085.csv' WHEN 1 THEN 'x_cal_ensemble_beta_g09.csv' ELSE 'submission_' || p_brand || '.csv' END"


@query("g15_name_parsing", f"WITH f AS (SELECT p_partkey, {FILES} AS f FROM part) SELECT p_partkey, CASE WHEN f LIKE '%isotonic%' THEN 'isotonic' WHEN f LIKE '%beta%' THEN 'beta' END AS method, "
       "CAST(CASE WHEN f LIKE '%isotonic%' THEN 0.85 WHEN f LIKE '%beta%' THEN 0.9 END AS DOUBLE) AS gamma FROM f")
def g15_name_parsing(spark, path):
    name = (F.when(F.col("p_size") % 3 == 0, "submission_cal_ensemble_isotonic_g085.csv").when(F.col("p_size") % 3 == 1, "x_cal_ensemble_beta_g09.csv")
            .otherwise(F.concat(F.lit("submission_"), "p_brand", F.lit(".csv"))))
    method, gamma = scores.calibration_from_name(name)
    return adapters.table(spark, path, "part").select("p_partkey", method.alias("method"), gamma.alias("gamma"))
