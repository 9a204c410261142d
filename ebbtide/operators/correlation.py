"""Correlations between score streams or features, agreement of streams, clusters of near duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.safe import clip
from ebbtide.operators.metrics import auc, scored, top_rows
from ebbtide.operators.ranks import average_ranks, row_numbers, running_totals
from ebbtide.runtime import materialize

# Fixed values.
REDUNDANT = 0.95
SAME_CLUSTER = 0.98
STABLE = {"std": 0.1, "rank_corr": 0.85, "overlap": 0.7}
BLOCK = 24
"""Columns whose pairs one aggregate of expressions holds."""
MOMENTS = ("n", "x", "y", "xx", "yy", "xy", "sx", "sy", "odd")
VAGUE = 1e-6
"""Squares around the mean below this share of the squares themselves have lost digits."""


def to_long(df: DataFrame, streams: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide score columns to (keep, model, p)."""
    entries = F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("p")) for s in streams])
    return df.select(*keep, F.inline(entries))


def to_wide(df: DataFrame, streams: Sequence[str], keep: Sequence[str], value: str = "p") -> DataFrame:
    """(keep, model, value) to one column per model; the models are named, so no extra job lists them."""
    return df.groupBy(*keep).pivot("model", list(streams)).agg(F.first(value))


def _pair_rows(values: dict[tuple[str, str], Column]) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("corr")) for (a, b), c in values.items()
    ]))


def _moments(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Moments of all pairs of columns over the rows that have both values: a few matrix products a batch, around a mean of the first values."""
    total, shift = np.zeros((7, k, k)), np.full(k, np.nan)
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
        given = np.stack([np.asarray(c.is_valid()) for c in batch.columns])
        fine = given & np.isfinite(x)
        for c in np.flatnonzero(np.isnan(shift) & fine.any(axis=1)):
            shift[c] = x[c, fine[c]].mean()
        x = np.where(fine, x - np.nan_to_num(shift)[:, None], 0.0)
        here, odd, square = given.astype(np.float64), (given & ~fine).astype(np.float64), x * x
        total += np.stack([here @ here.T, x @ here.T, here @ x.T, square @ here.T, here @ square.T, x @ x.T, odd @ here.T + here @ odd.T])
    i, j = np.triu_indices(k, 1)
    n, x, y, xx, yy, xy, odd = total[:, i, j]
    with np.errstate(invalid="ignore", divide="ignore"):
        moved = np.nan_to_num(shift)
        values = (n, moved[i] + x / n, moved[j] + y / n, xx - x * x / n, yy - y * y / n, xy - x * y / n, xx, yy, odd)
    some = n > 0
    yield pa.RecordBatch.from_pydict({"i": pa.array(i[some], pa.int32()), "j": pa.array(j[some], pa.int32())} | {c: v[some] for c, v in zip(MOMENTS, values)})


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for all pairs a < b in the order given; a pair uses the rows that have both values.

    More columns than ``BLOCK`` are read in one pass, in which each task returns the moments of every pair by matrix products, one row a
    pair. Pairs whose values hardly vary beside their size, so that sums lose digits, are left to the expression that few columns take.
    """
    columns, spark = list(columns), df.sparkSession
    if len(columns) <= BLOCK:
        return _plain_pairs(df, list(combinations(columns, 2)))
    k = len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = materialize(rows.mapInArrow(lambda b: _moments(b, k), "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS)))
    total = parts.groupBy("i", "j").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("x")).alias("_x"), F.sum(F.col("n") * F.col("y")).alias("_y"))
    total = total.select("i", "j", (F.col("_x") / F.col("_n")).alias("_x"), (F.col("_y") / F.col("_n")).alias("_y"))
    dx, dy, n = F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("n")
    sums = parts.join(total, ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("xx") + n * dx * dx).alias("vx"), F.sum(F.col("yy") + n * dy * dy).alias("vy"), F.sum(F.col("xy") + n * dx * dy).alias("vxy"),
        F.sum(F.col("sx") + n * F.col("x") * F.col("x")).alias("sx"), F.sum(F.col("sy") + n * F.col("y") * F.col("y")).alias("sy"), F.sum("odd").alias("odd"))
    fine = F.col("odd") == 0
    vague = fine & ((F.col("vx") <= VAGUE * F.col("sx")) | (F.col("vy") <= VAGUE * F.col("sy")))
    sums = materialize(sums.select("i", "j", vague.alias("vague"), F.when(fine & ~vague, F.col("vxy") / F.sqrt(F.col("vx") * F.col("vy"))).alias("corr")))
    left = {(r.i, r.j) for r in sums.where("vague").select("i", "j").collect()}
    names = [(i, j, columns[i], columns[j]) for i, j in combinations(range(k), 2) if (i, j) not in left]
    names = spark.createDataFrame(names, "i int, j int, a string, b string")
    out, again = [names.join(sums, ["i", "j"], "left").select("a", "b", "corr")], sorted(left)
    for s in range(0, len(again), BLOCK * BLOCK):
        some = again[s:s + BLOCK * BLOCK]
        out.append(_plain_pairs(rows, [(f"c{i}", f"c{j}") for i, j in some], [(columns[i], columns[j]) for i, j in some]))
    return reduce(DataFrame.unionByName, out)


def _plain_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(_pair_rows({p: F.nanvl(F.col(f"c{k}"), F.lit(None)) for k, p in enumerate(names or pairs)}))


def rank_columns(df: DataFrame, streams: Sequence[str], ids: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide table of average ranks, one column per stream, ranked over the whole table or inside ``by``."""
    long = to_long(df, streams, [*ids, *[c for c in by if c not in ids]])
    ranked = average_ranks(long, ["model", *by], "p", "rank")
    return to_wide(ranked, streams, [*ids, *[c for c in by if c not in ids]], "rank")


def spearman_pairs(df: DataFrame, streams: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks for all pairs."""
    return pearson_pairs(rank_columns(df, streams, ids), streams)


def kendall_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr), tau-b for all pairs a < b in the order given; a pair uses the rows that have both values.

    Two rows are compared once: at the highest bit in which the dense ranks of their second values differ. So each row of (first value,
    second value, count) is looked at once per bit: among rows that agree above it, ordered by the first value, the running counts of
    zeros and ones before it say how many pairs agree and how many do not. Ties in either value fall out by themselves. Rows are shuffled
    log n times in one job, and large groups are ordered by ranges. A pair without two different values of each has a null.
    """
    pairs = list(combinations(columns, 2))
    names = df.sparkSession.createDataFrame(pairs, "a string, b string")
    if not pairs:
        return names.withColumn("corr", F.lit(None).cast("double"))
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                     for a, b in pairs])
    counts = df.select(F.inline(both)).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    exact = "decimal(38,0)"

    def untied(value: str) -> DataFrame:
        """Twice the pairs of rows that differ in ``value``."""
        n = counts.groupBy("a", "b", value).agg(F.sum("n").cast(exact).alias("n")).groupBy("a", "b").agg(
            F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n")).cast(exact)).alias("ties"))
        return n.select("a", "b", (F.col("n").cast("double") * F.col("n") - F.col("ties")).alias(f"untied_{value}"))

    place = row_numbers(counts.select("a", "b", "y").distinct(), ["a", "b"], [F.col("y")], "q")
    bits = counts.join(place, ["a", "b", "y"]).withColumn("bit", F.explode(F.expr("sequence(0, length(bin(q_total - 1)) - 1)")))
    one = F.expr("shiftright(q - 1, bit) & 1")
    split = bits.withColumn("above", F.expr("shiftright(q - 1, bit + 1)")).groupBy("a", "b", "bit", "above", "x").agg(
        F.sum(F.col("n") * (1 - one)).alias("zeros"), F.sum(F.col("n") * one).alias("ones"))
    split = running_totals(split, ["a", "b", "bit", "above"], "x", ["zeros", "ones"])
    product = lambda c, d: F.col(c).cast("decimal(19,0)") * F.col(d).cast("decimal(19,0)")
    agree = split.groupBy("a", "b").agg(F.sum((product("ones", "zeros_before") - product("zeros", "ones_before")).cast(exact)).alias("agree"))
    out = names.join(agree, ["a", "b"], "left").join(untied("x"), ["a", "b"], "left").join(untied("y"), ["a", "b"], "left")
    scale = F.sqrt("untied_x") * F.sqrt("untied_y")
    return out.select("a", "b", F.when(scale > 0, 2 * F.col("agree").cast("double") / scale).alias("corr"))


def full_matrix(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Both directions of each pair plus the diagonal; undefined correlations count as 0."""
    both = pairs.select(
        F.inline(F.array(
            F.struct(F.col("a"), F.col("b"), F.col("corr")),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("corr")),
        ))
    )
    diag = pairs.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, corr double")
    return both.unionByName(diag).withColumn("corr", F.coalesce("corr", F.lit(0.0)))


def redundant_pairs(pairs: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    return pairs.where(F.abs("corr") >= threshold).orderBy(F.desc(F.abs("corr")), "a", "b")


def top_overlap(df: DataFrame, streams: Sequence[str], ids: Sequence[str], share: float = 0.1) -> DataFrame:
    """(a, b, overlap): the share of the top rows two streams have in common.

    Top rows are flagged per stream and laid side by side by id, so no pair of rows is ever formed. Rows that a
    stream did not score are not among its rows.
    """
    placed = row_numbers(scored(to_long(df, streams, ids), "p"), ["model"], [-F.col("p"), *[F.col(c) for c in ids]], "rn")
    k = top_rows(F.col("rn_total"), share, "int")
    top = placed.where(F.col("rn") <= k).select(*ids, "model", k.alias("k"))
    wide = top.groupBy(*ids).pivot("model", list(streams)).agg(F.first("k"))
    pairs = list(combinations(streams, 2))
    aggs = [
        F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
    ]
    one = wide.agg(*aggs, F.max(F.greatest(*streams) if len(streams) > 1 else F.col(streams[0])).alias("k"))
    values = F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"c{i}") / F.col("k")).alias("overlap"))
        for i, (a, b) in enumerate(pairs)
    ]))
    return one.select(values)


def stream_agreement(df: DataFrame, streams: Sequence[str], ids: Sequence[str], label: str = "y") -> DataFrame:
    """One row: mean row deviation, mean rank correlation, mean top overlap, deviation of AUC, and the verdict."""
    arr = F.array(*[F.col(s).cast("double") for s in streams])
    m = F.lit(float(len(streams)))
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / m
    var = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - F.col("_m")) * (x - F.col("_m"))) / m
    spread = df.withColumn("_m", mean).agg(F.avg(F.sqrt(var)).alias("pred_std"))
    ranks = spearman_pairs(df, streams, ids).agg(F.avg("corr").alias("rank_corr"))
    overlap = top_overlap(df, streams, ids).agg(F.avg("overlap").alias("top_overlap"))
    aucs = auc(to_long(df, streams, [*ids, label]), ["model"], "p", label).agg(F.stddev_pop("auc").alias("auc_std"))
    out = spread.select(
        "pred_std", ranks.scalar().alias("rank_corr"), overlap.scalar().alias("top_overlap"), aucs.scalar().alias("auc_std")
    )
    stable = (
        (F.col("pred_std") < STABLE["std"])
        & (F.col("rank_corr") > STABLE["rank_corr"])
        & (F.col("top_overlap") > STABLE["overlap"])
    )
    return out.withColumn("is_stable", stable)


def diversity_weights(matrix: DataFrame) -> DataFrame:
    """(model, w): one minus the mean correlation (self included), clipped to [0.1, 1], scaled to sum one."""
    d = matrix.groupBy(F.col("a").alias("model")).agg(clip(F.lit(1.0) - F.avg("corr"), 0.1, 1.0).alias("d"))
    return d.select("model", (F.col("d") / d.agg(F.sum("d")).scalar()).alias("w"))


def clusters(matrix: DataFrame, threshold: float = SAME_CLUSTER) -> DataFrame:
    """(name, cluster): connected components of the pairs at or above the threshold.

    Smallest-label propagation by join. Each round also jumps to the label's own label, so long chains close in a
    logarithmic number of rounds; rounds are written out, which keeps the plan short.
    """
    edges = materialize(matrix.where((F.col("corr") >= threshold) | (F.col("a") == F.col("b"))).select("a", "b"))
    labels = materialize(edges.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("cluster")))
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["name"])
            .groupBy(F.col("a").alias("name")).agg(F.min("cluster").alias("best"))
        )
        jump = labels.select(F.col("name").alias("best"), F.col("cluster").alias("further"))
        after = near.join(jump, "best").select("name", F.least("best", "further").alias("cluster"))
        after = materialize(after)
        moved = after.join(labels.withColumnRenamed("cluster", "was"), "name").where("cluster <> was").limit(1).count()
        labels = after
        if not moved:
            return labels


def medoids(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: size and the member with the lowest mean distance to all members, first name on ties."""
    left = labels.select(F.col("name").alias("a"), "cluster")
    right = labels.select(F.col("name").alias("b"), F.col("cluster").alias("other"))
    inside = matrix.join(left, "a").join(right, "b").where("cluster = other")
    dist = inside.groupBy("cluster", "a").agg(F.avg(F.lit(1.0) - F.col("corr")).alias("d"))
    return dist.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("a", F.struct(F.round("d", 12), "a")).alias("medoid")
    )


def diverse_pick(matrix: DataFrame, candidates: DataFrame, threshold: float = SAME_CLUSTER, k: int = 5) -> DataFrame:
    """Pick up to ``k`` candidates one by one, each below ``threshold`` correlation with those picked before.

    ``candidates`` has (name, score, calibration, gamma, last_n). Order: lowest correlation with the chosen, then
    fewest repeated settings, then best score, then name. Candidates without a correlation count as dissimilar.
    """
    picked: list = []
    spark = matrix.sparkSession
    while len(picked) < k:
        names = [p.name for p in picked]
        left = candidates.where(~F.col("name").isin(names)) if names else candidates
        near = matrix.where(F.col("b").isin(names)) if names else matrix.limit(0)
        near = near.groupBy(F.col("a").alias("name")).agg(F.max("corr").alias("max_corr"))
        left = left.join(near, "name", "left").withColumn("max_corr", F.coalesce("max_corr", F.lit(0.0)))
        if names:
            left = left.where(F.col("max_corr") < threshold - 1e-12)
        best = left.withColumn("penalty", _repeats(picked)).orderBy(
            "max_corr", "penalty", F.desc_nulls_last("score"), "name"
        ).first()
        if best is None:
            break
        picked.append(best)
    rows = [(i + 1, p.name, float(p.max_corr), int(p.penalty)) for i, p in enumerate(picked)]
    return spark.createDataFrame(rows, "place int, name string, max_corr double, penalty int")


def _repeats(picked: list) -> Column:
    def seen(attr):
        return [getattr(p, attr) for p in picked if getattr(p, attr) is not None]

    out = F.lit(0)
    for attr in ("calibration", "last_n"):
        if seen(attr):
            out = out + F.coalesce(F.col(attr).isin(seen(attr)), F.lit(False)).cast("int")
    if seen("gamma"):
        closest = F.array_min(F.array(*[F.abs(F.col("gamma") - F.lit(g)) for g in seen("gamma")]))
        out = out + F.coalesce(closest < 0.03, F.lit(False)).cast("int")
    return out
