"""Blends, weight searches and sweeps (K rows) on the three score streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import CUSTOMERS_SQL, customers, query
from checks.streams import ABC, ALLM, COMP, IDS, LAST6, S, long_streams, metric_ctes, r6, rnd, streams
from ebbtide.operators import blend, metrics
from ebbtide.operators.segments import quantile_segments
from ebbtide.sources import adapters

MIX = {"a": 0.5, "b": 0.3, "c": 0.2}
LO, HI = "0.000000001", "(1.0 - 0.000000001)"
CLIPPED = ", ".join(f"greatest(least(CAST({x} AS DOUBLE), {HI}), {LO}) AS c{x}" for x in ABC)
STRATEGIES = {
    "equal": "CAST(1 AS DOUBLE) / 3 * a + CAST(1 AS DOUBLE) / 3 * b + CAST(1 AS DOUBLE) / 3 * c",
    "weighted": "0.5 * a + 0.3 * b + 0.2 * c",
    "rank1": "CAST(3 AS DOUBLE) / 6 * a + CAST(2 AS DOUBLE) / 6 * b + CAST(1 AS DOUBLE) / 6 * c",
    "geometric": "exp((ln(ca) + ln(cb) + ln(cc)) / 3)",
    "harmonic": "1 / ((1 / ca + 1 / cb + 1 / cc) / 3)",
    "power2": "pow((pow(ca, 2) + pow(cb, 2) + pow(cc, 2)) / 3, 0.5)",
    "median": "list_sort([CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE)])[2]",
}


def strategies() -> dict:
    return {
        "equal": blend.equal(ABC),
        "weighted": blend.weighted(MIX),
        "rank1": blend.weighted({"a": 3, "b": 2, "c": 1}),
        "geometric": blend.power_mean(ABC, 0.0),
        "harmonic": blend.power_mean(ABC, -1.0),
        "power2": blend.power_mean(ABC, 2.0),
        "median": blend.median(ABC),
    }


BS = f"{S}, sc AS (SELECT *, {CLIPPED} FROM s)"


def blend_query(name: str, keys: list[str], digits: int = 6):
    sql = f"{BS} SELECT cust_id, ref_date, " + ", ".join(
        f"round({STRATEGIES[k]}, {digits}) + 0.0 AS {k}" for k in keys) + " FROM sc"
    query(name, sql)(lambda s, p: rnd(streams(s, p).select(*IDS, *[strategies()[k].alias(k) for k in keys]), digits))


# Streams have six digits, so tenths of them have seven: eight digits leave nothing to round.
blend_query("k6_weighted_blend", ["equal", "weighted"], 8)
blend_query("k8_power_means", ["geometric", "harmonic", "power2"])
blend_query("k9_median_blend", ["median"])


@query("k6_missing_model_blend", f"{S}, w(model, w) AS (VALUES ('a', 0.6), ('b', 0.4), ('z', 0.2)) SELECT cust_id, ref_date, "
       "round(sum(CAST(w AS DOUBLE) * p) / sum(CAST(w AS DOUBLE)), 6) + 0.0 AS p FROM l JOIN w USING (model) GROUP BY cust_id, ref_date")
def k6_missing_model_blend(spark, path):
    w = spark.createDataFrame([("a", 0.6), ("b", 0.4), ("z", 0.2)], "model string, w double")
    return rnd(blend.long_blend(long_streams(spark, path), w))


@query("k6_null_scores", f"{S}, ln AS (SELECT cust_id, ref_date, model, CASE WHEN (cust_id + ascii(model)) % 3 <> 0 THEN p END AS p FROM l), "
       "w(model, w) AS (VALUES ('a', 0.6), ('b', 0.4)) SELECT cust_id, ref_date, round(sum(CAST(w AS DOUBLE) * p) / sum(CAST(w AS DOUBLE)) "
       "FILTER (p IS NOT NULL), 6) + 0.0 AS p FROM ln JOIN w USING (model) GROUP BY cust_id, ref_date")
def k6_null_scores(spark, path):
    w = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "model string, w double")
    some = F.when((F.col("cust_id") + F.ascii("model")) % 3 != 0, F.col("p"))
    return rnd(blend.long_blend(long_streams(spark, path).withColumn("p", some), w))


@query("k7_rank_weights", f"{S}, {metric_ctes('l', 'model')}, o AS (SELECT model, row_number() OVER (ORDER BY round({COMP}, 9) DESC, model) AS rn, "
       "count(*) OVER () AS n FROM mt), w AS (SELECT model, CAST((n + 1 - rn) * (n + 1 - rn) AS DOUBLE) AS r FROM o) "
       "SELECT model, round(r / (SELECT sum(r) FROM w), 6) + 0.0 AS w FROM w")
def k7_rank_weights(spark, path):
    score = metrics.ranking_metrics(long_streams(spark, path), ["model"]).select("model", F.round("composite", 9).alias("score"))
    return rnd(blend.rank_weights(score, 2.0))


UNI = "un AS (" + " UNION ALL ".join(
    f"SELECT cust_id, ref_date, y, month, '{k}' AS strategy, {e} AS p FROM sm" for k, e in STRATEGIES.items()) + ")"
SM = f"sm AS (SELECT sc.*, date_trunc('month', ref_date)::DATE AS month FROM sc WHERE date_trunc('month', ref_date)::DATE IN (SELECT month FROM m6))"
query("k18_compare_strategies", f"{BS}, {LAST6}, {SM}, {UNI}, {metric_ctes('un', 'strategy, month', flip=True)} SELECT strategy, "
      f"round(avg({COMP}), 6) + 0.0 AS composite FROM mt GROUP BY strategy")(
    lambda s, p: rnd(blend.compare_strategies(streams(s, p), strategies())))

# ---------------------------------------------------------------- candidate scoring

STEPS = blend.GRID_STEPS
GRID = f"cd AS (SELECT i / {STEPS}.0 AS wa, j / {STEPS}.0 AS wb, ({STEPS} - i - j) / {STEPS}.0 AS wc, row_number() OVER (ORDER BY i, j) - 1 AS candidate " \
       f"FROM range({STEPS + 1}) x(i) CROSS JOIN range({STEPS + 1}) z(j) WHERE i + j <= {STEPS})"
CAND = (f"{S}, {GRID}, rc AS (SELECT cust_id, ref_date, y, date_trunc('month', ref_date)::DATE AS month, CAST(candidate AS INTEGER) AS candidate, "
        f"CAST(wa AS DOUBLE) * a + CAST(wb AS DOUBLE) * b + CAST(wc AS DOUBLE) * c AS p FROM s CROSS JOIN cd), "
        f"{metric_ctes('rc', 'month, candidate', flip=True)}, cs AS (SELECT month, candidate, {COMP} AS composite FROM mt)")


def grid() -> list:
    return blend.simplex_grid(ABC, STEPS)


def scored(spark, path) -> DataFrame:
    return blend.score_candidates(streams(spark, path), ABC, grid())


def chosen(spark, path) -> DataFrame:
    return blend.month_weights(blend.best_candidates(streams(spark, path), ABC, grid()), ABC, grid())


BEST = f"{CAND}, be AS (SELECT month, candidate, composite FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(composite, 9) DESC, candidate) AS r FROM cs) WHERE r = 1)"
WEIGHTS = (f"{BEST}, mw AS (SELECT month, 'a' AS model, CAST(wa AS DOUBLE) AS w FROM be JOIN cd USING (candidate) UNION ALL SELECT month, 'b', CAST(wb AS DOUBLE) FROM be JOIN cd USING (candidate) "
           "UNION ALL SELECT month, 'c', CAST(wc AS DOUBLE) FROM be JOIN cd USING (candidate))")

query("c13_score_candidates", f"{CAND} SELECT month, candidate, {r6('composite')} FROM cs")(
    lambda s, p: rnd(scored(s, p).select("month", "candidate", "composite")))
query("k11_best_per_month", f"{WEIGHTS} SELECT month, model, {r6('w')} FROM mw")(
    lambda s, p: rnd(chosen(s, p)))
query("k13_global_weights_median", f"{WEIGHTS}, g AS (SELECT model, median(w) AS w FROM mw GROUP BY model) SELECT model, round(w / (SELECT sum(w) FROM g), 6) + 0.0 AS w FROM g")(
    lambda s, p: rnd(blend.global_weights(chosen(s, p), "median")))
EMPH = {"2000-09": 0.2, "2000-11": 0.3, "2000-12": 0.5}
query("k13_global_weights_emphasis", f"{WEIGHTS}, e AS (SELECT model, w, CASE strftime(month, '%Y-%m') WHEN '2000-09' THEN 0.2 WHEN '2000-11' THEN 0.3 "
      "WHEN '2000-12' THEN 0.5 END::DOUBLE AS e FROM mw), g AS (SELECT model, sum(e * w) / sum(e) AS w FROM e WHERE e IS NOT NULL GROUP BY model) "
      "SELECT model, round(w / (SELECT sum(w) FROM g), 6) + 0.0 AS w FROM g")(
    lambda s, p: rnd(blend.global_weights(chosen(s, p), "emphasis", EMPH)))
LOOSE = ("ax AS (SELECT 0.1 + 0.9 * i / 4.0 AS v, i FROM range(5) r(i)), lc AS (SELECT CAST(x.v / (x.v + y.v + z.v) AS DOUBLE) AS wa, "
         "CAST(y.v / (x.v + y.v + z.v) AS DOUBLE) AS wb, CAST(z.v / (x.v + y.v + z.v) AS DOUBLE) AS wc, "
         "row_number() OVER (ORDER BY x.i, y.i, z.i) - 1 AS candidate FROM ax x, ax y, ax z WHERE abs(x.v + y.v + z.v - 1.0) < 0.15)")


@query("k14_free_weight_grid", f"{S}, {LOOSE}, rc AS (SELECT cust_id, ref_date, y, CAST(candidate AS INTEGER) AS candidate, wa * a + wb * b + wc * c AS p "
       f"FROM s CROSS JOIN lc), {metric_ctes('rc', 'candidate')} SELECT candidate, round({COMP}, 6) + 0.0 AS composite FROM mt")
def k14_free_weight_grid(spark, path):
    rows = blend.with_candidates(streams(spark, path), ABC, blend.loose_grid(3))
    return rnd(metrics.ranking_metrics(rows, ["candidate"]).select("candidate", "composite"))


TOP = 10


@query("k14_best_weights", f"{S}, {LOOSE}, rc AS (SELECT cust_id, ref_date, y, CAST(candidate AS INTEGER) AS candidate, wa * a + wb * b + wc * c AS p "
       f"FROM s CROSS JOIN lc), {metric_ctes('rc', 'candidate')}, o AS (SELECT candidate, {COMP} AS composite, "
       f"CAST(row_number() OVER (ORDER BY round({COMP}, 9) DESC, candidate) AS INTEGER) AS place FROM mt), "
       "w AS (SELECT candidate, 'a' AS model, wa AS w FROM lc UNION ALL SELECT candidate, 'b', wb FROM lc UNION ALL SELECT candidate, 'c', wc FROM lc) "
       f"SELECT place, candidate, {r6('composite')}, model, {r6('w')} FROM o JOIN w USING (candidate) WHERE place <= {TOP}")
def k14_best_weights(spark, path):
    return rnd(blend.best_weights(streams(spark, path), ABC, blend.loose_grid(3), TOP))


@query("c13_best_five", f"{CAND} SELECT month, candidate, {r6('composite')}, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month "
       "ORDER BY round(composite, 9) DESC, candidate) AS INTEGER) AS place FROM cs) WHERE place <= 5")
def c13_best_five(spark, path):
    return rnd(blend.best_candidates(streams(spark, path), ABC, grid(), top=5).select("month", "candidate", "composite", "place"))


TINY = "1e-14"


@query("c13_small_scores", f"{S}, {GRID}, rc AS (SELECT cust_id, ref_date, y, date_trunc('month', ref_date)::DATE AS month, CAST(candidate AS INTEGER) AS candidate, "
       f"CAST(wa AS DOUBLE) * (a * CAST({TINY} AS DOUBLE)) + CAST(wb AS DOUBLE) * (b * CAST({TINY} AS DOUBLE)) + CAST(wc AS DOUBLE) * (c * CAST({TINY} AS DOUBLE)) AS p "
       f"FROM s CROSS JOIN cd WHERE candidate < 20), {metric_ctes('rc', 'month, candidate', flip=True)} SELECT month, candidate, {r6('auc')}, round({COMP}, 6) + 0.0 AS composite FROM mt")
def c13_small_scores(spark, path):
    """Scores far below any rounding keep their order."""
    tiny = streams(spark, path).select(*IDS, "y", *[(F.col(x) * F.lit(float(TINY))).alias(x) for x in ABC])
    return rnd(blend.score_candidates(tiny, ABC, grid()[:20]).select("month", "candidate", "auc", "composite"))


LINES = ("SELECT m.month, CAST({at} + (i - 1) * 10 + st AS INTEGER) AS candidate, " + ", ".join(
    f"(1 - st / CAST(10 AS DOUBLE)) * w{x} + CASE WHEN i = {n} THEN st / CAST(10 AS DOUBLE) ELSE 0 END AS w{x}" for n, x in enumerate(ABC, 1))
    + " FROM {table} m, range(1, 4) u(i), range(1, 11) v(st)")
THIRD = "CAST(1 AS DOUBLE) / 3"


def rounds_sql(starts: list[list[float]]) -> str:
    """Two rounds of coordinate lines per month: around the even vector (and the starts), then around the best so far."""
    even = f"e1 AS (SELECT DISTINCT month, 0 AS candidate, {THIRD} AS wa, {THIRD} AS wb, {THIRD} AS wc FROM sm)"
    first = " UNION ALL ".join(["SELECT * FROM e1", *[
        f"SELECT month, {i} AS candidate, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE) FROM e1" for i, (a, b, c) in enumerate(starts, 1)],
        LINES.format(at=len(starts), table="e1")])

    def best(n: int) -> str:
        return (f"r{n} AS (SELECT sm.cust_id, sm.ref_date, sm.y, month, candidate, wa * a + wb * b + wc * c AS p FROM sm JOIN p{n} USING (month)), "
                + metric_ctes(f"r{n}", "month, candidate", flip=True, out=f"t{n}") +
                f", b{n} AS (SELECT month, candidate, composite, wa, wb, wc FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(composite, 9) DESC, candidate) AS r "
                f"FROM (SELECT month, candidate, {COMP} AS composite FROM t{n})) JOIN p{n} USING (month, candidate) WHERE r = 1)")

    return (f"{S}, sm AS (SELECT *, date_trunc('month', ref_date)::DATE AS month FROM s), {even}, p1 AS ({first}), {best(1)}, "
            f"p2 AS (SELECT month, 0 AS candidate, wa, wb, wc FROM b1 UNION ALL {LINES.format(at=0, table='b1')}), {best(2)}, "
            "w AS (SELECT month, b1.composite AS c1, b2.composite AS c2, " + ", ".join(f"CASE WHEN b2.composite > b1.composite THEN b2.w{x} ELSE b1.w{x} END AS w{x}" for x in ABC)
            + " FROM b1 JOIN b2 USING (month)) " + " UNION ALL ".join(
                f"SELECT month, '{x}' AS model, round((1 - 1e-4) * w{x} + 1e-4 / 3, 6) + 0.0 AS w, round(greatest(c1, c2), 6) + 0.0 AS composite FROM w" for x in ABC))


UNIT = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
query("k12_coordinate_rounds", rounds_sql([]))(lambda s, p: rnd(blend.search_per_month(streams(s, p), ABC, rounds=2, draws=0)))
query("k15_coordinate_starts", rounds_sql(UNIT))(lambda s, p: rnd(blend.search_per_month(streams(s, p), ABC, rounds=2, draws=0, starts=UNIT)))
# Random draws differ between engines; the same searches with the operator's own rounds and draws.
query("k12_search_per_month")(lambda s, p: blend.search_per_month(streams(s, p), ABC))
query("k15_multi_start_climb")(lambda s, p: blend.search_per_month(streams(s, p), ABC, rounds=8, draws=40, starts=UNIT))

# ---------------------------------------------------------------- sweeps, maps, rank space

GAM = ", ".join(f"({i}, {g})" for i, g in enumerate(blend.GAMMAS))
TMP = ", ".join(f"({i}, {g})" for i, g in enumerate(blend.TEMPERATURES))
PM = "(greatest(least(0.5 * a + 0.3 * b + 0.2 * c, 1 - 1e-6), 1e-6))"


def sweep_sql(table: str, expr: str) -> str:
    return (f"{S}, {LAST6}, gm(candidate, gamma) AS (VALUES {table}), sw AS (SELECT cust_id, ref_date, y, date_trunc('month', ref_date)::DATE AS month, "
            f"candidate, CAST(gamma AS DOUBLE) AS gamma, {expr} AS p FROM s CROSS JOIN gm WHERE date_trunc('month', ref_date)::DATE IN (SELECT month FROM m6)), "
            f"{metric_ctes('sw', 'candidate, gamma, month', flip=True)} SELECT CAST(candidate AS INTEGER) AS candidate, gamma, "
            f"round(avg({COMP}), 6) + 0.0 AS composite FROM mt GROUP BY candidate, gamma")


def mixed(spark, path) -> DataFrame:
    return streams(spark, path).select(*IDS, "y", blend.weighted(MIX).alias("p"))


query("k24_gamma_sweep", sweep_sql(GAM, f"greatest(least(pow({PM}, CAST(gamma AS DOUBLE)), 1 - 1e-6), 1e-6)"))(
    lambda s, p: rnd(blend.gamma_sweep(mixed(s, p))))
query("k17_temperature_search", sweep_sql(TMP, f"1 / (1 + exp(-CAST(gamma AS DOUBLE) * ln({PM} / (1 - {PM}))))"))(
    lambda s, p: rnd(blend.gamma_sweep(mixed(s, p), blend.TEMPERATURES, "temperature")))
query("k24_best_gamma", f"SELECT * FROM ({sweep_sql(GAM, f'greatest(least(pow({PM}, CAST(gamma AS DOUBLE)), 1 - 1e-6), 1e-6)')}) ORDER BY composite DESC, candidate LIMIT 1")(
    lambda s, p: rnd(blend.best_gamma(blend.gamma_sweep(mixed(s, p)), digits=6)))
query("k28_rank_space", f"{S} SELECT cust_id, ref_date, " + ", ".join(
    f"round((rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6) + 0.0 AS {x}" for x in ABC) + " FROM s")(
    lambda s, p: rnd(blend.rank_space(streams(s, p), ABC).select(*IDS, *ABC)))


@query("k27_fold_in", f"{S}, w AS (SELECT cust_id, ref_date, y + 1.0 AS t FROM s) SELECT cust_id, ref_date, round(0.9 * (y + 1.0) / (y + 2.0), 6) + 0.0 AS wa, "
       "round(0.9 / (y + 2.0), 6) + 0.0 AS wb, CAST(0.1 AS DOUBLE) AS wz FROM s")
def k27_fold_in(spark, path):
    base = F.create_map(F.lit("a"), (F.col("y") + 1.0) / (F.col("y") + 2.0), F.lit("b"), F.lit(1.0) / (F.col("y") + 2.0))
    w = streams(spark, path).select(*IDS, blend.fold_in(base, "z", 0.1).alias("w"))
    return rnd(w.select(*IDS, *[F.col("w")[k].alias(f"w{k}") for k in "abz"]))


@query("g16_json_weights", f"{S}, j AS (SELECT cust_id, ref_date, '{{\"a\": ' || CAST(a AS VARCHAR) || ', \"b\": 0.5}}' AS t FROM s) SELECT cust_id, ref_date, "
       "round(CAST(json_extract(t, '$.a') AS DOUBLE), 6) + 0.0 AS a, CAST(0.5 AS DOUBLE) AS b FROM j")
def g16_json_weights(spark, path):
    text = F.concat(F.lit('{"a": '), F.col("a").cast("decimal(9,6)").cast("string"), F.lit(', "b": 0.5}'))
    m = F.from_json(text, "map<string,double>")
    return rnd(streams(spark, path).select(*IDS, m["a"].alias("a"), m["b"].alias("b")))


QUART = ("t4 AS (SELECT cust_id, tenure, list_sort(list_distinct((SELECT quantile_cont(CAST(tenure AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) FROM customers))) AS e "
         "FROM customers), sg4 AS (SELECT cust_id, CAST(len(list_filter(e[2:len(e) - 1], lambda z: z < tenure)) AS INTEGER) AS seg FROM t4)")


def segmented(spark, path) -> DataFrame:
    people = quantile_segments(customers(spark, path).select("cust_id", "tenure"), "tenure", "seg")
    return streams(spark, path).join(people.select("cust_id", "seg"), "cust_id")


query("g17_quartile_segments", f"WITH {CUSTOMERS_SQL.strip()}, {QUART} SELECT cust_id, seg FROM sg4")(
    lambda s, p: quantile_segments(customers(s, p).select("cust_id", "tenure"), "tenure", "seg").select("cust_id", "seg"))
query("k16_segment_weights")(lambda s, p: s.createDataFrame(sorted(
    blend.segment_weights(segmented(s, p), ABC, ["seg"]).items()), "model string, w double"))
LEAST = "(SELECT CAST(count(*) / 4 AS BIGINT) FROM s)"


@query("k16_skipped", f"{S}, {CUSTOMERS_SQL.strip()}, {QUART} SELECT seg, count(*) AS n FROM s JOIN sg4 USING (cust_id) GROUP BY seg HAVING count(*) < {LEAST}")
def k16_skipped(spark, path):
    """Segments smaller than a quarter of the rows."""
    rows = segmented(spark, path)
    return blend.skipped_segments(rows, ABC, ["seg"], round(streams(spark, path).count() / 4))


query("k16_gram", f"{S}, {CUSTOMERS_SQL.strip()}, {QUART} SELECT seg, count(*) AS n, " + ", ".join(
    f"round(sum({x} * {y}), 4) + 0.0 AS g{i}_{j}" for i, x in enumerate(ABC) for j, y in enumerate(ABC) if i <= j)
    + ", " + ", ".join(f"round(sum({x} * y), 4) + 0.0 AS b{i}" for i, x in enumerate(ABC)) + " FROM s JOIN sg4 USING (cust_id) GROUP BY seg")(
    lambda s, p: rnd(blend.gram(segmented(s, p), ABC, ["seg"]), 4))

# ---------------------------------------------------------------- a second target: document quality by length

DOCS = ("WITH d AS (SELECT doc_id, CAST(quality AS INTEGER) AS y, round(n_chars / (n_chars + 5000.0), 6) AS p, doc_id AS cust_id, 0 AS ref_date "
        "FROM labels JOIN documents USING (doc_id))")


@query("i4_document_quality", f"{DOCS}, {metric_ctes('d', '')} SELECT n, positives, k, hits, {r6('auc', 'recall', 'lift')}, round({COMP}, 6) + 0.0 AS composite FROM mt")
def i4_document_quality(spark, path):
    d = adapters.table(spark, path, "labels").join(adapters.table(spark, path, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = d.select("doc_id", F.col("quality").cast("int").alias("y"), F.round(F.col("n_chars") / (F.col("n_chars") + 5000.0), 6).alias("p"))
    m = metrics.ranking_metrics(scored, ids=["doc_id"])
    return rnd(m.select("n", "positives", "k", "hits", "auc", "recall", "lift", "composite"))
