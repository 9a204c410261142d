"""Model jobs, stackers, calibration and portfolios (J and K rows).

What a fit returns depends on its engine. Its SQL states what must hold whatever the engine: the rows that are scored, with
their labels and scores inside [0, 1], or the conditions that an optimal fit meets.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.features import table
from checks.registry import COHORT_SQL, cohort, customers, query
from checks.streams import ABC, IDS, S, rnd, streams
from checks.tables import NUM, sides
from ebbtide.features.build import attach_labels
from ebbtide.functions.safe import clip
from ebbtide.operators import blend, folds, isotonic, metrics
from ebbtide.operators.metrics import monthly_composite
from ebbtide.operators.ranks import row_numbers
from ebbtide.plans import calibration, drift, newton, oof, portfolio, stacking, store
from ebbtide.runtime import materialize, scratch_dir
from ebbtide.sources import adapters

SMALL = {"maxIter": 4, "maxDepth": 3}
GBT = oof.Learner("gbt", SMALL)
FEATURES = [*NUM, "rfm_frequency_count_3m", "rfm_monetary_value_6m"]


def matrix(spark, path) -> DataFrame:
    return materialize(attach_labels(table(spark, path, ["rfm"], sentinel=True).select(*IDS, *FEATURES), cohort(spark, path)))


def halves(spark, path):
    m = matrix(spark, path)
    return m.where("ref_date < '2000-11-01'"), m.where("ref_date >= '2000-11-01'")


def meta(spark, path) -> DataFrame:
    return materialize(streams(spark, path).withColumnRenamed("y", "churn"))


def metric_row(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))


def inside(df: DataFrame, *scores: str) -> DataFrame:
    """Keys, label and whether every score lies in [0, 1]."""
    ok = F.lit(True)
    for c in scores or ("p",):
        ok = ok & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return df.select(*[c for c in (*IDS, "y") if c in df.columns], ok.alias("in_range"))


def last_rows(n: int, label: str = ", churn AS y") -> str:
    """The cohort rows of the last ``n`` months, each scored once."""
    return (f"WITH {COHORT_SQL.strip()} SELECT cust_id, ref_date{label}, true AS in_range FROM cohort "
            f"WHERE ref_date IN (SELECT DISTINCT ref_date FROM cohort ORDER BY ref_date DESC LIMIT {n})")


query("j1_boosted_oof", last_rows(6))(lambda s, p: inside(oof.train_oof(matrix(s, p), FEATURES, GBT, seeds=(1, 11)).oof))
SECOND = oof.Learner("newton", {"rounds": 3, "depth": 3, "rate": 0.3})
query("j2_second_boosted_oof", last_rows(6))(lambda s, p: inside(oof.train_oof(matrix(s, p), FEATURES, SECOND, seeds=(1,)).oof))

TREE = newton.NewtonBooster(rounds=1, depth=2, rate=0.1, bins=16, row_share=1.0, column_share=1.0)
SOFT = f"pow(greatest(abs({{g}}) - {TREE.l1}, 0), 2) / ({{h}} + {TREE.l2})"
VALUE = f"-{TREE.rate} * sign({{g}}) * greatest(abs({{g}}) - {TREE.l1}, 0) / ({{h}} + {TREE.l2})"


def tree_ctes() -> str:
    """The first tree level by level: sums per (node, feature, bin), every split's gain, the best one; nodes in v, splits in q."""
    probs = ", ".join(str(i / TREE.bins) for i in range(1, TREE.bins))
    ctes = [
        "x AS (SELECT row_number() OVER (ORDER BY cust_id, ref_date) AS id, cust_id, ref_date, y, a, b, c, (SELECT avg(y) FROM s) AS p FROM s)",
        "e AS (" + " UNION ALL ".join(f"SELECT {i} AS f, list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), [{probs}]))) AS e FROM x" for i, x in enumerate(ABC)) + ")",
        "r AS (" + " UNION ALL ".join(f"SELECT id, {i} AS f, CAST({x} AS DOUBLE) AS v FROM x" for i, x in enumerate(ABC)) + ")",
        "d AS (SELECT id, f, e, len(list_filter(e, lambda z: z <= v)) AS code FROM r JOIN e USING (f))",
        "n0 AS (SELECT id, p - y AS g, p * (1 - p) AS h, 0 AS node FROM x)",
    ]
    nodes = [f"SELECT 0 AS node, {VALUE.format(g='sum(g)', h='sum(h)')} AS value, sum(h) AS cover FROM n0"]
    for i in range(TREE.depth):
        gain = f"{SOFT.format(g='gl', h='hl')} + {SOFT.format(g='(gt - gl)', h='(ht - hl)')} - {SOFT.format(g='gt', h='ht')}"
        ctes += [
            f"h{i} AS (SELECT node, f, code, any_value(e) AS e, sum(g) AS g, sum(h) AS h FROM n{i} JOIN d USING (id) GROUP BY node, f, code)",
            f"c{i} AS (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht "
            f"FROM h{i} WINDOW u AS (PARTITION BY node, f ORDER BY code))",
            f"s{i} AS (SELECT *, round({gain}, 9) AS gain FROM c{i} WHERE hl >= {TREE.child} AND ht - hl >= {TREE.child})",
            f"b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, code) AS r FROM s{i}) WHERE r = 1 AND gain > {newton.LEAST_GAIN})",
            f"n{i + 1} AS (SELECT n.id, n.g, n.h, 2 * n.node + CASE WHEN d.code <= b.code THEN 1 ELSE 2 END AS node FROM n{i} n JOIN b{i} b USING (node) JOIN d ON d.id = n.id AND d.f = b.f)",
        ]
        nodes += [f"SELECT 2 * node + 1, {VALUE.format(g='gl', h='hl')}, hl FROM b{i}", f"SELECT 2 * node + 2, {VALUE.format(g='(gt - gl)', h='(ht - hl)')}, ht - hl FROM b{i}"]
    splits = " UNION ALL ".join(f"SELECT node, f, e[code + 1] AS threshold, gain FROM b{i}" for i in range(TREE.depth))
    return f"{S}, {', '.join(ctes)}, v AS ({' UNION ALL '.join(nodes)}), q AS ({splits})"


def tree_sql() -> str:
    return (f"{tree_ctes()} SELECT CAST(node AS INTEGER) AS node, CAST(coalesce(f, -1) AS INTEGER) AS feature, "
            "round(coalesce(threshold, 0.0), 6) + 0.0 AS threshold, round(coalesce(gain, 0.0), 6) + 0.0 AS gain, round(value, 6) + 0.0 AS value FROM v LEFT JOIN q USING (node)")


@query("j2_newton_first_tree", tree_sql())
def j2_newton_first_tree(spark, path):
    """Splits, gains and values of the first tree on the three streams."""
    tree = TREE.fit(oof.assemble(meta(spark, path), ABC)).trees[0]
    inner = {2 * i + side for i, f in enumerate(tree.feature.tolist()) if f >= 0 for side in (1, 2)} | {0}
    rows = [(i, int(tree.feature[i]), float(tree.threshold[i]), float(tree.gain[i]), float(tree.value[i])) for i in sorted(inner)]
    return rnd(spark.createDataFrame(rows, "node int, feature int, threshold double, gain double, value double"))


def shapley_sql() -> str:
    """Shapley values by their definition: the tree's value for every set of known features, then the weighted differences."""
    x = "CASE {t}.f WHEN 0 THEN x.a WHEN 1 THEN x.b ELSE x.c END"
    pick = ("CASE WHEN {t}.f IS NULL THEN {t}.value WHEN (mask >> {t}.f) & 1 = 1 THEN CASE WHEN " + x + " < {t}.threshold THEN {l} ELSE {r} END "
            "ELSE (lc.cover * {l} + rc.cover * {r}) / (lc.cover + rc.cover) END")
    weight = {0: "1 / 3.0", 1: "1 / 6.0", 2: "1 / 3.0"}
    parts = [" + ".join(f"{weight[m.bit_count()]} * (z[{(m | 1 << i) + 1}] - z[{m + 1}])" for m in range(8) if not m >> i & 1) for i in range(3)]
    return (f"{tree_ctes()}, m AS (SELECT unnest(range(8)) AS mask), t AS (SELECT v.node, value, cover, f, threshold FROM v LEFT JOIN q USING (node)), "
            f"k AS (SELECT x.id, mask, t.node, {pick.format(t='t', l='lc.value', r='rc.value')} AS val FROM x CROSS JOIN m JOIN t ON t.node IN (1, 2) "
            "LEFT JOIN t lc ON lc.node = 2 * t.node + 1 LEFT JOIN t rc ON rc.node = 2 * t.node + 2), "
            f"g AS (SELECT x.id, kl.mask, {pick.format(t='t', l='kl.val', r='kr.val').replace('(mask', '(kl.mask')} AS val FROM x JOIN k kl ON kl.id = x.id AND kl.node = 1 "
            "JOIN k kr ON kr.id = x.id AND kr.mask = kl.mask AND kr.node = 2 JOIN t ON t.node = 0 JOIN t lc ON lc.node = 1 JOIN t rc ON rc.node = 2), "
            "z AS (SELECT id, list(val ORDER BY mask) AS z FROM g GROUP BY id) SELECT cust_id, ref_date, "
            + ", ".join(f"round({p}, 6) + 0.0 AS {c}" for c, p in zip(ABC, parts)) + " FROM z JOIN x USING (id)")


@query("j9_attributions", shapley_sql())
def j9_attributions(spark, path):
    """What each stream adds to every row's margin, by the first tree."""
    rows = materialize(oof.assemble(meta(spark, path), ABC))
    got = TREE.fit(rows).explain(rows)
    return got.select(*IDS, *[(F.round(F.col("contributions")[i], 6) + 0.0).alias(c) for i, c in enumerate(ABC)])


@query("j9_attributions_add_up", last_rows(99, "").replace("in_range", "adds_up"))
def j9_attributions_add_up(spark, path):
    """A row's contributions and the mean add up to the log odds of its score, for models of several trees."""
    rows = materialize(oof.assemble(matrix(spark, path), FEATURES))
    model = SECOND.estimator(1).fit(rows)
    got = model.transform(model.explain(rows))
    total = F.aggregate("contributions", F.lit(model.expected()), lambda a, b: a + b)
    return got.select(*IDS, (F.abs(total - F.ln(F.col("score") / (1 - F.col("score")))) < 1e-9).alias("adds_up"))


BOOTSTRAP = oof.Learner("newton", {"rounds": 3, "depth": 3, "rate": 0.3, "bootstrap": 1.0, "row_share": 1.0})
query("j3_bootstrap_oof", last_rows(6))(lambda s, p: inside(oof.train_oof(matrix(s, p), FEATURES, BOOTSTRAP, seeds=(1,)).oof))

FOREST = oof.Learner("forest", {"numTrees": 8, "maxDepth": 4})
query("j3_forest_oof", last_rows(6))(lambda s, p: inside(oof.train_oof(matrix(s, p), FEATURES, FOREST, seeds=(1, 2)).oof))
query("j4_rank_averaged_oof", last_rows(6))(lambda s, p: inside(oof.train_oof(matrix(s, p), FEATURES, FOREST, seeds=(1, 2), average="rank").oof))


@query("j5_two_stage", last_rows(3))
def j5_two_stage(spark, path):
    two = oof.train_two_stage(matrix(spark, path), FEATURES, GBT, GBT, last_n=3)
    return inside(two.stage_b.oof.select(*IDS, "y", "p").join(two.stage_a.oof.select(*IDS, F.col("p").alias("pA")), IDS), "p", "pA")


LATE = f"WITH {COHORT_SQL.strip()} SELECT cust_id, ref_date, true AS in_range FROM cohort WHERE ref_date >= '2000-11-01'"


@query("j6_two_stage_scores", LATE)
def j6_two_stage_scores(spark, path):
    train, test = halves(spark, path)
    return inside(oof.train_two_stage(train, FEATURES, GBT, GBT, last_n=2).predict(test)).drop("y")


@query("j7_mean_of_models", LATE)
def j7_mean_of_models(spark, path):
    train, test = halves(spark, path)
    return inside(oof.train_oof(train, FEATURES, GBT, last_n=2, seeds=(1, 11)).predict(test)).drop("y")


@query("j7_saved_models", f"WITH {COHORT_SQL.strip()} SELECT cust_id, ref_date, true AS same FROM cohort WHERE ref_date >= '2000-11-01'")
def j7_saved_models(spark, path):
    """Two stages trained, saved, loaded: the loaded ones score every row as the saved ones."""
    train, test = halves(spark, path)
    learner = oof.Learner("logistic")
    two = oof.train_two_stage(train, FEATURES, learner, GBT, last_n=1)
    folder = f"{scratch_dir(spark)}/models/{uuid.uuid4().hex}"
    store.save_two_stage(two, folder)
    again = store.load_two_stage(spark, folder).predict(test).select(*IDS, F.col("p").alias("q"))
    return two.predict(test).join(again, IDS, "left").select(*IDS, (F.abs(F.col("p") - F.col("q")) < 1e-9).alias("same"))


def shares(importance: DataFrame, by: str) -> DataFrame:
    """How many features have a gain, per fold; whether none is negative and they add up to one."""
    return importance.groupBy(by).agg(
        F.count(F.lit(1)).alias("features"), (F.min("gain") >= 0).alias("none_negative"), (F.abs(F.sum("gain") - 1) < 1e-6).alias("sums_to_one")).drop(by)


query("j9_model_importance", f"SELECT CAST({len(FEATURES)} AS BIGINT) AS features, true AS none_negative, true AS sums_to_one FROM range(6)")(
    lambda s, p: shares(oof.train_oof(matrix(s, p), FEATURES, GBT, seeds=(1,)).importance(), "fold"))


@query("j10_domain_classifier")
def j10_domain_classifier(spark, path):
    d = drift.domain_classifier(*halves(spark, path), FEATURES, GBT, k=3)
    return d.importance.groupBy("feature").agg(F.avg("gain").alias("gain")).withColumn("domain_auc", F.lit(d.auc))


query("j11_drop_drifting")(lambda s, p: drift.drop_drifting(*halves(s, p), FEATURES, 2, oof.Learner("logistic"))[1])
query("j12_iterative_filter")(lambda s, p: drift.iterative_filter(
    *halves(s, p), FEATURES, 2, 0.5, 0.5, oof.Learner("logistic"), last_n=2, max_steps=2)[1])
query("j13_one_by_one_filter")(lambda s, p: drift.one_by_one_filter(
    *halves(s, p), FEATURES, 0.5, 2, oof.Learner("logistic"), last_n=2)[1])
query("j14_drift_report")(lambda s, p: drift.drift_report(*halves(s, p), FEATURES, learner=GBT))
query("h13_odds_weights")(lambda s, p: drift.domain_weights(*halves(s, p), FEATURES))


@query("e14_mean_of_two_rankings")
def e14_mean_of_two_rankings(spark, path):
    train, test = halves(spark, path)
    d = drift.domain_classifier(train, test, FEATURES, GBT, holdout=True)
    rows = drift.domain_rows(train, test, FEATURES)
    return drift.mean_rank(d.importance, drift.permutation_importance(d, rows, FEATURES))


@query("e14_attribution_ranking")
def e14_attribution_ranking(spark, path):
    """The features that tell the halves apart, ranked by what they add to the margins and by what their exchange costs."""
    train, test = halves(spark, path)
    d = drift.domain_classifier(train, test, FEATURES, SECOND, holdout=True)
    rows = drift.domain_rows(train, test, FEATURES)
    return drift.mean_rank(drift.attribution_importance(d, rows, FEATURES), drift.permutation_importance(d, rows, FEATURES))


query("j15_pseudo_label_round")(lambda s, p: oof.pseudo_label_round(*halves(s, p), FEATURES, oof.Learner("logistic"), last_n=2))
query("j16_steady_features")(lambda s, p: oof.steady_features(matrix(s, p), FEATURES, GBT, 3))
query("j17_cross_period")(lambda s, p: oof.cross_period(matrix(s, p), FEATURES, GBT, 3))
query("j18_parameter_search")(lambda s, p: oof.search(
    matrix(s, p), FEATURES, [oof.with_params(GBT, maxDepth=d) for d in (2, 3)], last_n=2))
query("j18_halving_search")(lambda s, p: oof.halving_search(
    matrix(s, p), FEATURES, [oof.Learner("newton", {"rounds": 2, "depth": d, "rate": r}) for d in (2, 3) for r in (0.1, 0.3)]))
query("j20_mini_evaluation")(lambda s, p: oof.mini_evaluation(matrix(s, p), FEATURES, GBT))
query("f6_pseudo_labels", f"{S}, o AS (SELECT *, row_number() OVER (ORDER BY a, cust_id, ref_date) AS rn, count(*) OVER () AS n FROM s) "
      "SELECT cust_id, ref_date, CAST(CASE WHEN rn <= greatest(1, round_even(0.4 * n, 0)) THEN 0 ELSE 1 END AS INTEGER) AS churn FROM o "
      "WHERE rn <= greatest(1, round_even(0.4 * n, 0)) OR rn > n - greatest(1, round_even(0.025 * n, 0))")(
    lambda s, p: oof.pseudo_labels(streams(s, p).withColumn("p", F.col("a"))).select(*IDS, "churn"))

query("f6_null_scores", f"{S}, v AS (SELECT * FROM s WHERE cust_id % 7 <> 0), o AS (SELECT *, row_number() OVER (ORDER BY a, cust_id, ref_date) AS rn, "
      "count(*) OVER () AS n FROM v) SELECT cust_id, ref_date, CAST(CASE WHEN rn <= greatest(1, round_even(0.4 * n, 0)) THEN 0 ELSE 1 END AS INTEGER) AS churn "
      "FROM o WHERE rn <= greatest(1, round_even(0.4 * n, 0)) OR rn > n - greatest(1, round_even(0.025 * n, 0))")(
    lambda s, p: oof.pseudo_labels(streams(s, p).withColumn("p", F.when(F.col("cust_id") % 7 != 0, F.col("a")))).select(*IDS, "churn"))

# ---------------------------------------------------------------- stackers


@query("k1_meta_features", f"{S} SELECT s.cust_id, s.ref_date, s.y AS churn, a AS oof_a, b AS oof_b, d AS r FROM s JOIN "
       "(SELECT cust_id, ref_date, CAST(r AS BIGINT) AS d FROM sg) z USING (cust_id, ref_date)")
def k1_meta_features(spark, path):
    from ebbtide.operators.correlation import to_long

    long = to_long(streams(spark, path), ["a", "b"], [*IDS, "y"])
    raw = table(spark, path, ["rfm"]).select(*IDS, F.coalesce("rfm_frequency_count", F.lit(0)).alias("r"))
    return stacking.meta_features(long, ["a", "b"], raw, ["r"])


query("k2_month_stacker", last_rows(6))(lambda s, p: inside(stacking.month_stacker(meta(s, p), ABC, last_n=6).oof))
@query("k2_penalty", f"{S}, m AS (SELECT DISTINCT date_trunc('month', ref_date)::DATE AS month FROM s), f AS (SELECT month AS fold FROM m ORDER BY 1 DESC LIMIT 6) "
       "SELECT strftime(fold, '%Y-%m') AS fold, count(*) AS n, true AS optimal FROM f JOIN s ON date_diff('month', date_trunc('month', ref_date)::DATE, fold) >= 2 GROUP BY fold")
def k2_penalty(spark, path):
    """The stacker of every month meets the first-order conditions of a sum of losses plus half the squared coefficients (c = 1)."""
    rows = materialize(oof.assemble(meta(spark, path), ABC).withColumn("x", vector_to_array("features")))
    got, out = stacking.month_stacker(meta(spark, path), ABC), []
    for split in oof.month_splits(rows):
        scaler, model = next(m for f, _, m in got.models if f == split.name).stages
        b, z = model.coefficients, [(F.col("x")[i] - float(scaler.mean[i])) / float(scaler.std[i]) for i in range(len(ABC))]
        margin = F.lit(float(model.intercept))
        for i, x in enumerate(z):
            margin = margin + float(b[i]) * x
        off = 1 / (1 + F.exp(-margin)) - F.col("y")
        sums = rows.where(split.train).agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("g"), *[F.sum(off * x).alias(f"g{i}") for i, x in enumerate(z)]).first()
        steep = max(abs(sums.g), *[abs(sums[f"g{i}"] + float(b[i])) for i in range(len(ABC))])
        out.append((split.name, sums.n, steep < 1e-3 * sums.n ** 0.5))
    return spark.createDataFrame(out, "fold string, n long, optimal boolean")


query("k3_kfold_stacker", last_rows(99))(lambda s, p: inside(stacking.kfold_stacker(meta(s, p), ABC, k=5).oof))
query("k3_compare_stackers")(lambda s, p: stacking.compare_stackers(meta(s, p), ["a", "b"], ["c"], GBT, 2))
query("k4_forward_stacker")(lambda s, p: stacking.forward_stacker(meta(s, p), ABC, (0.1, 1.0), 3)[0].oof)
query("k5_meta_selector")(lambda s, p: stacking.select_meta(meta(s, p), ABC, {
    "logistic": [stacking.logistic(c) for c in (0.1, 1.0)], "ridge": [oof.Learner("ridge")], "boosted": [GBT]}, last_n=2).oof)

# ---------------------------------------------------------------- calibration


def raw(spark, path) -> DataFrame:
    return streams(spark, path).select(*IDS, "y", blend.weighted({"a": 0.5, "b": 0.3, "c": 0.2}).alias("p"))


ONE_ROW = "SELECT count(*) AS n, CAST(0 AS BIGINT) AS falls, true AS means_kept, true AS auc_kept FROM s"


def isotonic_check(df: DataFrame) -> DataFrame:
    """Rows; places where the fit falls; whether each step is the mean of its labels; whether the ranking got no worse."""
    rows = materialize(df)
    fitted = materialize(calibration.fit(rows, "isotonic").apply(rows.withColumn("x", F.col("p"))))
    ladder = fitted.groupBy("x").agg(F.max("p").alias("p"))
    falls = running_falls(ladder)
    means = fitted.groupBy(F.round("p", 9).alias("p")).agg(F.avg("y").alias("m")).agg(F.coalesce(F.max(F.abs(F.col("m") - F.col("p"))) < 1e-6, F.lit(False)).alias("means_kept"))
    before, after = (metrics.auc(d.select("p", "y")).select(F.col("auc").alias(n)) for d, n in ((rows, "_before"), (fitted, "_after")))
    one = fitted.agg(F.count(F.lit(1)).alias("n")).crossJoin(falls).crossJoin(means).crossJoin(before).crossJoin(after)
    return one.select("n", "falls", "means_kept", (F.col("_after") >= F.col("_before") - 1e-9).alias("auc_kept"))


def running_falls(ladder: DataFrame) -> DataFrame:
    """How many pairs of neighbouring scores are calibrated in the wrong order."""
    placed = row_numbers(ladder, [], [F.col("x")], "rn").select("rn", "p")
    after = placed.select((F.col("rn") - 1).alias("rn"), F.col("p").alias("q"))
    return placed.join(after, "rn").agg(F.count_if(F.col("q") < F.col("p") - 1e-12).alias("falls"))


query("k19_isotonic", f"{S} {ONE_ROW}")(lambda s, p: isotonic_check(raw(s, p)))
# Rare events: every score is far below a millionth, and all of them differ by less.
query("k19_small_scores", f"{S} {ONE_ROW}")(lambda s, p: isotonic_check(raw(s, p).withColumn("p", F.col("p") / 1e7)))
query("k20_isotonic_out_of_fold", f"{S} SELECT cust_id, ref_date, y, true AS in_range FROM s")(lambda s, p: inside(calibration.out_of_fold(
    folds.stratified_folds(raw(s, p), "y", IDS, 5), "fold", "isotonic")))


# Isotonic fits by their min-max formula: the largest, over starts up to a score, of the smallest mean over ends from it on.
MIN_MAX = ("n AS (SELECT *, sum(w) OVER o AS cw, sum(wy) OVER o AS cy, row_number() OVER o AS i FROM pts WINDOW o AS (PARTITION BY g ORDER BY p)), "
           "mm AS (SELECT l.g, l.i AS i, r.i AS j, (r.cy - l.cy + l.wy) / (r.cw - l.cw + l.w) AS v FROM n l JOIN n r ON l.g = r.g AND r.i >= l.i), "
           "mi AS (SELECT g, i, j, min(v) OVER (PARTITION BY g, i ORDER BY j DESC) AS v FROM mm), "
           "fit AS (SELECT n.g, n.p, z.v FROM (SELECT g, j, max(v) AS v FROM mi GROUP BY g, j) z JOIN n ON n.g = z.g AND n.i = z.j)")
NATIONS = (f"{S}, b AS (SELECT cust_id, ref_date, y, n_name AS province, CAST(cust_id % 5 AS INTEGER) AS fold, CAST(a * 0.5 + b * 0.3 + c * 0.2 AS DOUBLE) AS p "
           "FROM s JOIN customer ON c_custkey = cust_id JOIN nation ON n_nationkey = c_nationkey)")


def by_nation(spark, path) -> DataFrame:
    p = (F.col("a") * 0.5 + F.col("b") * 0.3 + F.col("c") * 0.2).alias("p")
    scores = streams(spark, path).select(*IDS, "y", p, (F.col("cust_id") % 5).cast("int").alias("fold"))
    return materialize(scores.join(customers(spark, path).select("cust_id", "province"), "cust_id"))


@query("k21_isotonic_by_nation", f"{NATIONS}, pts AS (SELECT province AS g, p, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS wy FROM b GROUP BY 1, 2), "
       f"{MIN_MAX} SELECT cust_id, ref_date, round(v, 6) + 0.0 AS p FROM b JOIN fit ON fit.g = b.province AND fit.p = b.p")
def k21_isotonic_by_nation(spark, path):
    """One curve a nation, all of them fitted and used in one job each."""
    rows = by_nation(spark, path)
    curves = isotonic.fit_curves(calibration.points(rows, by=["province"]).withColumnRenamed("province", "g"))
    return rows.select(*IDS, (F.round(curves.at(F.col("province"), F.col("p")), 6) + 0.0).alias("p"))


@query("k20_isotonic_folds_by_nation", f"{NATIONS}, f AS (SELECT unnest(range(5)) AS fold), "
       "pts AS (SELECT province || f.fold AS g, p, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS wy FROM b JOIN f ON b.fold <> f.fold GROUP BY 1, 2), "
       f"{MIN_MAX}, r AS (SELECT *, province || fold AS g FROM b), d AS (SELECT r.*, fit.p AS p0, fit.v AS v0 FROM r ASOF LEFT JOIN fit ON r.g = fit.g AND r.p >= fit.p), "
       "u AS (SELECT d.*, fit.p AS p1, fit.v AS v1 FROM d ASOF LEFT JOIN fit ON d.g = fit.g AND d.p <= fit.p) "
       "SELECT cust_id, ref_date, round(CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 6) + 0.0 AS p FROM u")
def k20_isotonic_folds_by_nation(spark, path):
    """Every fold of every nation by the nation's other folds: 125 fits in one job."""
    got = calibration.out_of_fold(by_nation(spark, path), "fold", within=["province"])
    return got.select(*IDS, (F.round("p", 6) + 0.0).alias("p"))


@query("k21_segment_isotonic", f"{S} SELECT cust_id, ref_date, y, true AS in_range FROM s")
def k21_segment_isotonic(spark, path):
    binned, n, _ = calibration.segment_bins(materialize(streams(spark, path).select(*IDS, "y", "c", F.col("a").alias("p"))), "c")
    binned = materialize(binned)
    return inside(calibration.fit_segments(binned, n).apply(binned))


def logistic_check(df: DataFrame, method: str, intercept: bool = True) -> DataFrame:
    """Rows, and whether the fit is optimal: with its penalty, no coefficient has any slope left."""
    rows = materialize(df)
    made = calibration.fit(rows, method, intercept=intercept)
    p, y = F.col("p"), F.col("y")
    fitted = made.apply(rows.withColumn("x", p))
    safe = clip(F.col("x"), calibration.EPS, 1 - calibration.EPS)
    inputs = [F.col("x")] if method == "platt" else [F.ln(safe), F.ln(1 - safe)]
    slopes = [F.sum((y - p) * x) - F.lit(float(c)) for x, c in zip(inputs, made.model.coefficients, strict=True)]
    slopes += [F.sum(y - p)] if intercept else []
    flat = F.lit(True)
    for g in slopes:
        flat = flat & (F.abs(g) / F.count(F.lit(1)) < 1e-4)
    return fitted.agg(F.count(F.lit(1)).alias("n"), flat.alias("optimal"))


OPTIMAL = f"{S} SELECT count(*) AS n, true AS optimal FROM s"
query("k22_beta", OPTIMAL)(lambda s, p: logistic_check(raw(s, p), "beta"))
query("k22_beta_without_intercept", OPTIMAL)(lambda s, p: logistic_check(raw(s, p), "beta", False))
query("k23_platt", OPTIMAL)(lambda s, p: logistic_check(raw(s, p), "platt"))


@query("k21_saved_calibrators", f"{S} SELECT cust_id, ref_date, true AS same FROM s")
def k21_saved_calibrators(spark, path):
    binned, n, _ = calibration.segment_bins(materialize(streams(spark, path).select(*IDS, "y", "c", F.col("a").alias("p"))), "c", 100)
    binned = materialize(binned)
    made = calibration.fit_segments(binned, n, "beta", min_rows=100)
    folder = f"{scratch_dir(spark)}/models/{uuid.uuid4().hex}"
    store.save_segments(spark, made, folder)
    again = store.load_segments(spark, folder).apply(binned).select(*IDS, F.col("p").alias("q"))
    return made.apply(binned).join(again, IDS, "left").select(*IDS, (F.abs(F.col("p") - F.col("q")) < 1e-9).alias("same"))


@query("k25_method_choice")
def k25_method_choice(spark, path):
    r = materialize(raw(spark, path))
    got = calibration.choose(r.where("ref_date < '2000-11-01'"), r.where("ref_date >= '2000-11-01'"))
    return got.test.withColumns({"method": F.lit(got.method), "gamma": F.lit(got.gamma)})


query("k26_recalibrate")(lambda s, p: calibration.recalibrate(
    raw(s, p).where("ref_date < '2000-11-01'"), raw(s, p).where("ref_date >= '2000-11-01'"), "beta", 1.05)[1])
TEMPLATES = [{"a": 0.5, "b": 0.5}, {"a": 0.7, "b": 0.3}]
query("k28_portfolio")(lambda s, p: portfolio.build(
    streams(s, p), TEMPLATES, "c", (0.0, 0.1), (False, True), ("isotonic",), (0.95, 1.0)))


@query("k28_portfolio_scores")
def k28_portfolio_scores(spark, path):
    train, test = streams(spark, path, adapters.TRAIN_DATES), streams(spark, path, adapters.SCORE_DATES)
    kept = portfolio.build(train, TEMPLATES[:1], "c", (0.1,), (False, True), ("beta",), (1.0,))
    return portfolio.emit(test, train, kept)


@query("k29_variant_rescore")
def k29_variant_rescore(spark, path):
    stored = spark.createDataFrame(
        [(1, '{"a": 0.5, "b": 0.5}', "isotonic", 0.95), (2, '{"a": 0.9, "c": 0.1}', "none", 1.0)],
        "id int, weights string, calibration string, gamma double")
    return portfolio.rescore(streams(spark, path), stored)


# Variants built from the parts table: the brand stands for the weight signature, the price for the score.
VARIANT_SQL = ("WITH v AS (SELECT p_brand AS signature, CASE WHEN p_size % 2 = 0 THEN 'isotonic' ELSE 'beta' END AS calibration, CAST(p_size % 5 AS DOUBLE) AS gamma, "
               "CAST(0.0 AS DOUBLE) AS share, false AS ranks, p_retailprice AS composite, p_partkey AS blend FROM part), "
               "k AS (SELECT *, row_number() OVER (PARTITION BY calibration, gamma, share, signature, ranks ORDER BY round(composite, 9) DESC, blend) AS a FROM v), "
               "g AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY round(composite, 9) DESC, calibration, gamma, blend) AS b FROM k WHERE a = 1), "
               "t AS (SELECT * FROM g WHERE b <= 4 ORDER BY round(composite, 9) DESC, signature, calibration, gamma, blend LIMIT 25) ")


@query("e13_thin_variants", VARIANT_SQL + "SELECT signature, calibration, gamma, composite FROM t")
def e13_thin_variants(spark, path):
    v = adapters.table(spark, path, "part").select(
        F.col("p_brand").alias("signature"), F.when(F.col("p_size") % 2 == 0, "isotonic").otherwise("beta").alias("calibration"),
        (F.col("p_size") % 5).cast("double").alias("gamma"), F.lit(0.0).alias("share"), F.lit(False).alias("ranks"),
        F.col("p_retailprice").alias("composite"), F.col("p_partkey").alias("blend"),
        F.create_map(F.lit("a"), F.lit(1.0)).alias("weights"))
    return portfolio.thin(v).select("signature", "calibration", "gamma", "composite")
