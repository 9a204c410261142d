"""Blending score streams and searching blend weights.

Streams are columns of one wide table keyed by (cust_id, ref_date). A search bounds all candidate weight vectors of a round by counts
and ranks only those that may be best (``search.py``). ``score_candidates`` ranks every candidate: each row emits one score per
candidate, and equal scores are counted before anything is shuffled.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.periods import month_start
from ebbtide.functions.safe import clip, logit, sigmoid
from ebbtide.operators import search
from ebbtide.operators.correlation import rank_columns
from ebbtide.operators.metrics import last_months, monthly_composite, ranking_metrics, scored
from ebbtide.operators.ranks import join_keys
from ebbtide.runtime import materialize

# Fixed values.
KEYS = ("cust_id", "ref_date")
EPS = 1e-9
BATCH = 20_000
"""Candidates that one job scores; more are scored in several."""
GRID_STEPS = 20
EMPHASIS = {"2018-09": 0.2, "2018-11": 0.3, "2018-12": 0.5}
TEMPERATURES = tuple(round(0.7 + 0.05 * i, 2) for i in range(13))
GAMMAS = tuple(round(0.80 + 0.05 * i, 2) for i in range(11))

Weights = Mapping[str, float]


# ---------------------------------------------------------------- fixed blends


def weighted(weights: Weights, present: Sequence[str] | None = None) -> Column:
    """Weighted mean of the streams; the weights of absent streams are redistributed."""
    use = {m: w for m, w in weights.items() if present is None or m in present}
    total = sum(use.values()) or 1.0
    out = F.lit(0.0)
    for m, w in use.items():
        out = out + F.lit(float(w) / total) * F.col(m)
    return out


def equal(streams: Sequence[str]) -> Column:
    return weighted({m: 1.0 for m in streams})


def long_blend(predictions: DataFrame, weights: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean per id of a long prediction table; ``weights`` has (model, w).

    Absent models and null scores drop out with their weights; an id without any score has a null.
    """
    joined = predictions.join(materialize(weights), "model")
    given = F.when(F.col("p").isNotNull(), F.col("w"))
    return joined.groupBy(*by).agg((F.sum(F.col("w") * F.col("p")) / F.nullif(F.sum(given), F.lit(0.0))).alias("p"))


def rank_weights(scores: DataFrame, power: float = 1.0) -> DataFrame:
    """(model, w) from the place of each model by score: (n + 1 - place) ** power, scaled to sum one."""
    # One row per model.
    all_rows = Window.partitionBy(F.lit(0))
    place = F.row_number().over(all_rows.orderBy(F.desc("score"), "model"))
    raw = scores.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(all_rows))
    raw = raw.withColumn("r", F.pow(F.col("n") + 1 - F.col("place"), F.lit(float(power))))
    return raw.select("model", (F.col("r") / F.sum("r").over(all_rows)).alias("w"))


def power_mean(streams: Sequence[str], power: float) -> Column:
    """1 arithmetic, 0 geometric, -1 harmonic, otherwise the general power mean."""
    n = F.lit(float(len(streams)))

    def mean(fn) -> Column:
        out = F.lit(0.0)
        for s in streams:
            out = out + fn(F.col(s) if power == 1.0 else clip(F.col(s), EPS, 1.0 - EPS))
        return out / n

    if power == 1.0:
        return mean(lambda x: x)
    if power == 0.0:
        return F.exp(mean(F.ln))
    if power == -1.0:
        return F.lit(1.0) / mean(lambda x: F.lit(1.0) / x)
    return F.pow(mean(lambda x: F.pow(x, F.lit(power))), F.lit(1.0 / power))


def median(streams: Sequence[str]) -> Column:
    """Median of the streams of one row."""
    ordered = F.sort_array(F.array(*[F.col(s).cast("double") for s in streams]))
    n = len(streams)
    mid = F.element_at(ordered, n // 2 + 1)
    return mid if n % 2 else (F.element_at(ordered, n // 2) + mid) / F.lit(2.0)


def rank_space(df: DataFrame, streams: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Streams replaced by their average rank scaled to [0, 1], so that a blend never mixes scales."""
    ranks = rank_columns(df, streams, KEYS, by)
    rest = [c for c in df.columns if c not in streams]
    joined = df.select(*rest).join(ranks, list(dict.fromkeys([*KEYS, *by])))
    sizes = df.groupBy(*by).agg(*[F.count(s).alias(f"_n_{s}") for s in streams])
    if by:
        joined = joined.join(materialize(sizes), list(by))
    else:
        joined = joined.select("*", *[sizes.select(f"_n_{s}").scalar().alias(f"_n_{s}") for s in streams])
    return joined.select(
        *rest, *[((F.col(s) - 1) / F.greatest(F.col(f"_n_{s}") - 1, F.lit(1))).alias(s) for s in streams]
    )


def fold_in(weights: Column, name: str, share: float) -> Column:
    """A weight map with ``name`` added at ``share``: the others shrink by it, then all are scaled to sum one."""
    shrunk = F.transform_values(weights, lambda _, w: F.greatest(w * F.lit(1.0 - share), F.lit(0.0)))
    both = F.map_concat(shrunk, F.create_map(F.lit(name), F.lit(float(share)))) if share > 0 else weights
    total = F.aggregate(F.map_values(both), F.lit(0.0), lambda acc, w: acc + w)
    return F.transform_values(both, lambda _, w: w / total)


# ---------------------------------------------------------------- candidates


def simplex_grid(streams: Sequence[str], steps: int = GRID_STEPS) -> list[list[float]]:
    """All weight vectors in steps of ``1 / steps`` that sum to one. Their number grows fast with the streams."""
    def parts(k: int, left: int) -> list[list[int]]:
        return [[left]] if k == 1 else [[c, *rest] for c in range(left + 1) for rest in parts(k - 1, left - c)]

    return [[c / steps for c in p] for p in parts(len(streams), steps)]


def simplex_draws(streams: Sequence[str], trials: int = 500, seed: int = 42) -> list[list[float]]:
    """Random weight vectors that sum to one, for more streams than a grid is good for."""
    rng = random.Random(seed)
    return [_dirichlet(rng, [1.0] * len(streams)) for _ in range(trials)]


def loose_grid(k: int, points: int = 5, tolerance: float = 0.15) -> list[list[float]]:
    """Grid vectors of free weights from 0.1 to 1 whose sum is close to one, scaled to sum one."""
    axis = [0.1 + 0.9 * i / (points - 1) for i in range(points)]
    close = (c for c in product(axis, repeat=k) if abs(sum(c) - 1.0) < tolerance)
    return [[w / sum(c) for w in c] for c in close]


def _dirichlet(rng: random.Random, alpha: Sequence[float]) -> list[float]:
    draws = [rng.gammavariate(a, 1.0) for a in alpha]
    return [d / sum(draws) for d in draws]


def with_candidates(df: DataFrame, streams: Sequence[str], candidates: Sequence[Sequence[float]], keep: bool = False) -> DataFrame:
    """Each row once per candidate with ``candidate`` (its position) and the blended score ``p``; ``keep`` leaves the streams in."""
    text = json.dumps([{"candidate": i, "w": list(w)} for i, w in enumerate(candidates)])
    table = F.from_json(F.lit(text), "array<struct<candidate:int,w:array<double>>>")
    return _blended(df.select("*", F.inline(table)), streams, keep)


def _blended(df: DataFrame, streams: Sequence[str], keep: bool = False) -> DataFrame:
    # The additions have one order everywhere, so equal blends tie bit by bit.
    score = F.element_at("w", 1) * F.col(streams[0])
    for i, s in enumerate(streams[1:], 2):
        score = score + F.element_at("w", i) * F.col(s)
    return df.select(*[c for c in df.columns if c != "w" and (keep or c not in streams)], score.alias("p"))


def score_candidates(
    df: DataFrame, streams: Sequence[str], candidates: Sequence[Sequence[float]], label: str = "y",
    last_n: int | None = None
) -> DataFrame:
    """(month, candidate, metrics...) with the per-month flip guard; one job for ``BATCH`` candidates.

    Rows of one month that agree in all streams and the label have equal blends whatever the weights: they are counted first, and
    each such vector is scored once per candidate. Only vectors tied at the border of the top share meet their rows again.
    """
    rows = last_months(df, last_n) if last_n else df.withColumn("month", month_start(F.col("ref_date")))
    names = [f"_stream_{i}" for i in range(len(streams))]
    slim = materialize(rows.select(*KEYS, "month", F.col(label).alias("y"), *[F.col(s).alias(n) for s, n in zip(streams, names)]))
    same = ["month", *names, "y"]
    vectors = materialize(slim.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows")))

    def members(ties: DataFrame) -> DataFrame:
        return join_keys(slim, materialize(ties.select(*same, "candidate", "_need")), same)

    parts = []
    for i in range(0, max(len(candidates), 1), BATCH):
        blends = with_candidates(vectors, names, candidates[i:i + BATCH], keep=True)
        some = ranking_metrics(blends, ["month", "candidate"], flip=True, weight="_rows", members=members)
        parts.append(some.withColumn("candidate", F.col("candidate") + i))
    return reduce(DataFrame.unionByName, parts)


def best_per_month(scored: DataFrame, digits: int = 9) -> DataFrame:
    """Best candidate of each month; the first one on ties."""
    rank = F.struct(F.round("composite", digits), -F.col("candidate"))
    return scored.groupBy("month").agg(
        F.max_by("candidate", rank).alias("candidate"), F.max("composite").alias("composite")
    )


def best_candidates(
    df: DataFrame, streams: Sequence[str], candidates: Sequence[Sequence[float]], label: str = "y", last_n: int | None = None, top: int = 1
) -> DataFrame:
    """(month, candidate, metrics..., place): the best ``top`` candidates of each month, as ``score_candidates`` would find them.

    Most candidates are ruled out by counts and never ranked.
    """
    rows = last_months(df, last_n) if last_n else df.withColumn("month", month_start(F.col("ref_date")))
    rows = rows.select(*KEYS, F.date_format("month", "yyyy-MM").alias("_group"), F.col(label).alias("_y"), *streams)
    ready = search.prepared(rows, streams, KEYS)
    found = search.search_prepared(ready, {m: dict(enumerate(candidates)) for m in ready.groups}, top)
    return found.select(F.to_date(F.concat("_group", F.lit("-01"))).alias("month"), *[c for c in found.columns if c != "_group"])


def best_weights(df: DataFrame, streams: Sequence[str], candidates: Sequence[Sequence[float]], top: int = 1, label: str = "y") -> DataFrame:
    """(place, candidate, composite, model, w): the best ``top`` weight vectors over all rows, without a flip guard."""
    rows = df.select(*KEYS, F.lit("all").alias("_group"), F.col(label).alias("_y"), *streams)
    found = search.search(rows, streams, {"all": candidates}, KEYS, top, flip=False).select("place", "candidate", "composite")
    text = json.dumps(list(map(list, candidates)))
    chosen = F.element_at(F.from_json(F.lit(text), "array<array<double>>"), F.col("candidate") + 1)
    names = F.array(*[F.lit(s) for s in streams])
    pairs = F.inline(F.arrays_zip(names.alias("model"), chosen.alias("w")))
    return found.select("place", "candidate", "composite", pairs)


def month_weights(best: DataFrame, streams: Sequence[str], candidates: Sequence[Sequence[float]]) -> DataFrame:
    """Best candidates as (month, model, w)."""
    text = json.dumps(list(map(list, candidates)))
    chosen = F.element_at(F.from_json(F.lit(text), "array<array<double>>"), F.col("candidate") + 1)
    names = F.array(*[F.lit(s) for s in streams])
    return best.select("month", F.explode(F.arrays_zip(names.alias("model"), chosen.alias("w"))).alias("x")).select(
        "month", F.col("x.model").alias("model"), F.col("x.w").alias("w")
    )


def global_weights(weights: DataFrame, mode: str = "median", emphasis: Mapping[str, float] | None = None) -> DataFrame:
    """(model, w) over months: the median, the mean, or a mean weighted by named months; scaled to sum one."""
    if mode == "emphasis":
        table = F.create_map(*[F.lit(x) for kv in (emphasis or EMPHASIS).items() for x in kv])
        share = F.try_element_at(table, F.date_format("month", "yyyy-MM"))
        w = weights.withColumn("e", share).where("e is not null").groupBy("model").agg(
            (F.sum(F.col("e") * F.col("w")) / F.sum("e")).alias("w")
        )
    else:
        # One row per month: the exact median of a calendar's worth of numbers.
        w = weights.groupBy("model").agg((F.median("w") if mode == "median" else F.avg("w")).alias("w"))
    return w.select("model", (F.col("w") / w.agg(F.sum("w")).scalar()).alias("w"))


# ---------------------------------------------------------------- searches


def search_per_month(
    df: DataFrame,
    streams: Sequence[str],
    rounds: int = 4,
    draws: int = 20,
    seed: int = 42,
    pull: float = 1e-4,
    label: str = "y",
    starts: Sequence[Sequence[float]] = (),
) -> DataFrame:
    """(month, model, w, composite) by rounds of coordinate lines and random draws around the best vector so far.

    One search takes every candidate of every month in a round. Only the best vector per month comes back to the
    driver. Several ``starts`` make it a multi-start climb. The rows are written once for all rounds. A vector that a month
    had in an earlier round did not exceed the best one (or is it), so it is not looked at again, and neither is ranked what
    can't exceed it.
    """
    ready = search.prepared(
        df.select(*KEYS, F.date_format("ref_date", "yyyy-MM").alias("_group"), F.col(label).alias("_y"), *streams), streams, KEYS)
    k, rng = len(streams), random.Random(seed)
    even = [1.0 / k] * k
    best: dict[str, tuple[float, list[float]]] = {}
    tried: dict[str, set[tuple[float, ...]]] = {m: set() for m in ready.groups}
    for r in range(rounds):
        candidates: dict[str, list[list[float]]] = {}
        for m in sorted(ready.groups):
            centre = best[m][1] if m in best else even
            pool = [centre] if m in best else [even, *[list(s) for s in starts]]
            for i in range(k):
                for step in range(1, 11):
                    a = step / 10.0
                    pool.append([(1 - a) * w + (a if j == i else 0.0) for j, w in enumerate(centre)])
            pool += [_dirichlet(rng, [1.0 + 50.0 * w for w in centre]) for _ in range(draws)]
            candidates[m] = pool
        new = {m: {i: w for i, w in enumerate(pool) if tuple(w) not in tried[m]} for m, pool in candidates.items()}
        for row in search.search_prepared(ready, new, known={m: score for m, (score, _) in best.items()}).collect():
            m = row._group
            if row.composite is not None and (m not in best or row.composite > best[m][0]):
                best[m] = (row.composite, candidates[m][row.candidate])
        for m, pool in candidates.items():
            tried[m].update(map(tuple, pool))
    out = [
        (f"{m}-01", s, (1 - pull) * w + pull / k, score)
        for m, (score, ws) in sorted(best.items())
        for s, w in zip(streams, ws)
    ]
    made = df.sparkSession.createDataFrame(out, "month string, model string, w double, composite double")
    return made.withColumn("month", F.col("month").cast("date"))


def sweep(df: DataFrame, by: Sequence[str], values: Sequence[float], fn, last_n: int = 6) -> DataFrame:
    """(by, candidate, gamma, composite) of ``fn(p, gamma)``, never falling in p for a positive gamma; monthly composite over the last months.

    Such a transform keeps the order, so metrics change only where it merges scores. Scores are counted once, the distinct ones are
    transformed, and only months and values in which some of them merge are ranked again.
    """
    rows = materialize(scored(last_months(df, last_n), "p", "y").select(*by, "month", *KEYS, "p", "y"))
    table = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(float(g)).alias("gamma")) for i, g in enumerate(values)])
    plain = ranking_metrics(rows, [*by, "month"], flip=True).select(*by, "month", "composite")
    spread = rows.select(*by, "month", "p").distinct().select(*by, "month", "p", F.inline(table))
    left = spread.withColumn("_q", fn(F.col("p"), F.col("gamma"))).groupBy(*by, "month", "candidate", "gamma")
    # One row per group, month and value.
    merged = materialize(left.agg(((F.count("p") > F.count_distinct("_q")) | (F.col("gamma") <= 0)).alias("_merged")))
    out = join_keys(merged.where("NOT _merged"), plain, [*by, "month"])
    again = materialize(merged.where("_merged").drop("_merged"))
    if not again.isEmpty():
        copies = join_keys(rows, again, [*by, "month"]).withColumn("p", fn(F.col("p"), F.col("gamma")))
        copies = ranking_metrics(copies, [*by, "month", "candidate", "gamma"], flip=True)
        out = out.select(*by, "month", "candidate", "gamma", "composite").unionByName(copies.select(*by, "month", "candidate", "gamma", "composite"))
    return out.groupBy(*by, "candidate", "gamma").agg(F.avg("composite").alias("composite"))


def gamma_sweep(df: DataFrame, gammas: Sequence[float] = GAMMAS, kind: str = "power", last_n: int = 6) -> DataFrame:
    """(candidate, gamma, composite) of p ** gamma, or of the logit scaled by gamma; monthly composite over the last months."""

    def power(p: Column, g: Column) -> Column:
        return clip(F.pow(clip(p, 1e-6, 1 - 1e-6), g), 1e-6, 1 - 1e-6)

    def temperature(p: Column, g: Column) -> Column:
        return sigmoid(g * logit(p))

    return sweep(df, [], gammas, power if kind == "power" else temperature, last_n)


def best_gamma(sweep: DataFrame, digits: int = 9) -> DataFrame:
    """The best row; the transforms are monotone, so scores usually tie and the first gamma wins."""
    return sweep.orderBy(F.desc_nulls_last(F.round("composite", digits)), "candidate").limit(1)


def compare_strategies(df: DataFrame, blends: Mapping[str, Column], last_n: int = 6, label: str = "y") -> DataFrame:
    """(strategy, composite), best first. Every strategy is a column, scored together in one job."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("strategy"), c.alias("p")) for n, c in blends.items()
    ])
    long = df.select(*KEYS, F.col(label).alias("y"), F.inline(entries))
    return monthly_composite(long, ["strategy"], last_n).select("strategy", "composite").orderBy(
        F.desc_nulls_last(F.round("composite", 9)), "strategy"
    )


# ---------------------------------------------------------------- non-negative ridge weights


def gram(df: DataFrame, streams: Sequence[str], by: Sequence[str], label: str = "y") -> DataFrame:
    """Per group: row count, X'X and X'y of the streams — all a ridge fit needs, by plain partial sums."""
    k = len(streams)
    xx = [F.sum(F.col(streams[i]) * F.col(streams[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    xy = [F.sum(F.col(s) * F.col(label)).alias(f"b{i}") for i, s in enumerate(streams)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *xx, *xy)


def _ridge_simplex(n: int, g: list[list[float]], b: list[float], l2: float) -> list[float]:
    """Non-negative ridge on k numbers by cyclic coordinate descent, scaled to sum one."""
    k = len(b)
    w = [0.0] * k
    for _ in range(10_000):
        moved = 0.0
        for i in range(k):
            rest = b[i] - sum(g[i][j] * w[j] for j in range(k) if j != i)
            new = max(0.0, rest / (g[i][i] + l2 * n)) if g[i][i] + l2 * n > 0 else 0.0
            moved = max(moved, abs(new - w[i]))
            w[i] = new
        if moved < 1e-12:
            break
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1.0 / k] * k


def _fit(df: DataFrame, streams: Sequence[str], segments: Sequence[str], l2: float, label: str, least: int) -> DataFrame:
    """(n, model, w): the ridge fit of each segment with at least ``least`` rows, solved where its sums lie."""
    k = len(streams)
    names = list(streams)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = [[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
                w = _ridge_simplex(r["n"], g, [r[f"b{i}"] for i in range(k)], l2)
                rows += [(r["n"], m, x) for m, x in zip(names, w)]
            yield pd.DataFrame(rows, columns=["n", "model", "w"])

    sums = gram(df, streams, segments, label).where(F.col("n") >= least)
    return sums.drop(*segments).mapInPandas(solve, "n long, model string, w double")


def least_rows(streams: Sequence[str]) -> int:
    return max(200, 50 * len(streams))


def segment_weights(
    df: DataFrame, streams: Sequence[str], segments: Sequence[str], l2: float = 1e-3, label: str = "y", least: int | None = None
) -> dict[str, float]:
    """Blend weights as the size-weighted mean of per-segment non-negative ridge fits.

    Segments below ``least`` rows (max(200, 50 per stream)) are skipped, ``skipped_segments`` names them; with none left the global fit is
    used. Rows are reduced to k-by-k sums per segment, the sums are solved in the tasks that hold them, and one weight per stream comes back.
    """
    fitted = materialize(_fit(df, streams, segments, l2, label, least_rows(streams) if least is None else least))
    if fitted.isEmpty():
        fitted = _fit(df, streams, [], l2, label, 0)
    mixed = fitted.groupBy("model").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).collect()
    total = sum(r.w for r in mixed)
    return {r.model: r.w / total for r in mixed}


def skipped_segments(df: DataFrame, streams: Sequence[str], segments: Sequence[str], least: int | None = None) -> DataFrame:
    """(segments..., n): the segments that ``segment_weights`` leaves out, with their rows."""
    sizes = df.groupBy(*segments).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") < (least_rows(streams) if least is None else least))
