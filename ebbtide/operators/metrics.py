"""Ranking metrics per group: AUC, recall and lift in the top share, the weighted composite.

Rows are first counted per distinct score, and the counts are placed by ``running_totals``: a month (or one
global group) is never sorted in a single task. Only the rows tied at the border of the top share are looked at
one by one, because there the id decides. Rows without a score or a label are in no count and no rank;
``unscored`` says how many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.periods import month_start
from ebbtide.functions.safe import ratio
from ebbtide.operators.ranks import join_keys, percentiles, row_numbers, running_totals
from ebbtide.runtime import materialize

# Fixed values of the metric.
BASE_AUC = 0.6925726757936908
BASE_RECALL = 0.18469015795868773
BASE_LIFT = 1.847159286784029
WEIGHTS = (0.4, 0.3, 0.3)
TOP_SHARE = 0.1


def top_rows(n: Column, share: float = TOP_SHARE, rounding: str = "half_even") -> Column:
    """How many rows the top share holds: at least one."""
    raw = F.lit(share) * n
    k = {"half_even": F.rint(raw), "int": F.floor(raw).cast("double"), "ceil": F.ceil(raw).cast("double")}[rounding]
    return F.greatest(F.lit(1.0), k).cast("long")


def composite(gini: Column, recall: Column, lift: Column, normalise: bool = True) -> Column:
    wg, wr, wl = (F.lit(w) for w in WEIGHTS)
    if not normalise:
        return wg * gini + wr * recall + wl * lift
    return (
        gini / F.lit(2 * BASE_AUC - 1) * wg + recall / F.lit(BASE_RECALL) * wr + lift / F.lit(BASE_LIFT) * wl
    )


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    # One global group is a group like any other.
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def scored(df: DataFrame, *columns: str) -> DataFrame:
    """The rows that have all of ``columns``."""
    return df.na.drop("any", subset=list(columns))


def unscored(df: DataFrame, by: Sequence[str] = (), score: str = "p", label: str = "y") -> DataFrame:
    """Rows per group, and those that the metrics leave out: without a score, and with a score but no label."""
    no_score, no_label = F.col(score).isNull(), F.col(score).isNotNull() & F.col(label).isNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(no_score).alias("no_score"), F.count_if(no_label).alias("no_label"))


def _counts(df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    rows = F.lit(1) if weight is None else F.col(weight)
    return scored(df, score, label).groupBy(*by, (-F.col(score)).alias("_key")).agg(
        F.sum(rows).cast("long").alias("n"), F.sum(F.col(label).cast("long") * rows).alias("pos")
    )


def _auc(pairs: Column, pos: Column, n: Column) -> Column:
    return ratio(pairs, F.nullif(pos * (n - pos), F.lit(0)))


def _pairs() -> Column:
    # Scores run from high to low: a negative is beaten by the positives before it, half by those tied with it.
    return F.sum((F.col("n") - F.col("pos")) * (F.col("pos_before") + F.col("pos") / F.lit(2.0)))


def auc(df: DataFrame, by: Sequence[str] = (), score: str = "p", label: str = "y") -> DataFrame:
    """ROC-AUC per group, ties counting half; null when a group has one class only."""
    df, keys = _grouped(df, by)
    # Written, as the cut points and the ranges read them: the rows are scored and counted once.
    run = running_totals(materialize(_counts(df, keys, score, label)), keys, "_key", ["n", "pos"])
    out = run.groupBy(*keys).agg(_pairs().alias("_u"), F.max("n_total").alias("n"), F.max("pos_total").alias("positives"))
    return out.select(*by, "n", "positives", _auc(F.col("_u"), F.col("positives"), F.col("n")).alias("auc"))


def flip_guard(df: DataFrame, by: Sequence[str] = (), score: str = "p", label: str = "y") -> DataFrame:
    """Replace the score by one minus itself in the groups whose AUC is below one half."""
    df, keys = _grouped(df, by)
    low = materialize(auc(df, keys, score, label).where("auc < 0.5").select(*keys, F.lit(True).alias("_flip")))
    out = join_keys(df, low, keys, "left")
    guarded = F.when(F.col("_flip"), F.lit(1.0) - F.col(score)).otherwise(F.col(score))
    return out.withColumn(score, guarded).drop("_flip", "_all")


def ranking_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    score: str = "p",
    label: str = "y",
    ids: Sequence[str] = ("cust_id", "ref_date"),
    share: float = TOP_SHARE,
    rounding: str = "half_even",
    normalise: bool = True,
    flip: bool = False,
    weight: str | None = None,
    members: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """n, positives, k, hits, auc, gini, recall, lift, composite and whether the score was flipped, per group.

    Rows with equal scores at the border of the top share are taken in the order of ``ids``. With ``flip`` a group
    whose AUC is below one half is scored on one minus the score: the same counts, read from the other end.

    With ``weight`` a row stands for that many rows of one score and label; ``members`` then gives, for those tied at the border,
    the rows themselves with the ids, the label, the group and all columns that begin with an underscore.
    """
    df, keys = _grouped(df, by)
    run = running_totals(_counts(df, keys, score, label, weight), keys, "_key", ["n", "pos"])
    groups = materialize(border(run, keys, ["_key"], _pairs(), share, rounding, flip))
    mixed = (F.col("_tied_pos") > 0) & (F.col("_tied_pos") < F.col("_tied_n"))
    ties = join_keys(
        scored(df, score, label).withColumn("_key", -F.col(score)), groups.where(mixed).select(*keys, "_key", "_need"), [*keys, "_key"]
    )
    ties = ties if members is None else members(ties)
    taken = first_rows(ties.select(*keys, *ids, label, "_need"), keys, [F.col(c) for c in ids], label)
    return measured(groups, taken, keys, normalise).drop(*[k for k in keys if k not in by])


def border(run: DataFrame, keys: Sequence[str], at: Sequence[str], pairs: Column, share: float = TOP_SHARE,
           rounding: str = "half_even", flip: bool = False) -> DataFrame:
    """Per group the totals, AUC and ``flipped``, the positives surely in the top share (_full), and what lies across its border:
    the columns ``at``, its rows and positives (_tied_n, _tied_pos) and how many of its rows belong to the share (_need).

    ``run`` has scores, or runs of scores, from high to low with n, pos, n_before, pos_before, n_total and pos_total. There is one row
    per group: written out, the planner sees its size before it is joined to the rows.
    """
    run = run.withColumns(
        {
            "k": top_rows(F.col("n_total"), share, rounding),
            "n_after": F.col("n_total") - F.col("n_before") - F.col("n"),
        }
    )
    sides = {"f": "n_before"} | ({"r": "n_after"} if flip else {})
    picks = []
    for s, ahead in sides.items():
        at_border = (F.col(ahead) < F.col("k")) & (F.col(ahead) + F.col("n") > F.col("k"))
        inside = F.col(ahead) + F.col("n") <= F.col("k")
        picks += [
            F.sum(F.when(inside, F.col("pos")).otherwise(0)).alias(f"_full_{s}"),
            F.max(F.when(at_border, F.struct(*at, (F.col("k") - F.col(ahead)).alias("need"), "n", "pos"))).alias(f"_border_{s}"),
        ]
    totals = run.groupBy(*keys).agg(
        pairs.alias("_u"), F.max("n_total").alias("n"), F.max("pos_total").alias("positives"),
        F.max("k").alias("k"), *picks,
    )
    raw = _auc(F.col("_u"), F.col("positives"), F.col("n"))
    flipped = F.coalesce(raw < 0.5, F.lit(False)) if flip else F.lit(False)
    totals = totals.select(
        *keys, "n", "positives", "k", flipped.alias("flipped"),
        F.when(flipped, F.lit(1.0) - raw).otherwise(raw).alias("auc"),
        *[
            (F.when(flipped, F.col(f"_{c}_r")).otherwise(F.col(f"_{c}_f")) if flip else F.col(f"_{c}_f")).alias(f"_{c}")
            for c in ("full", "border")
        ],
    )
    return totals.select(
        *keys, F.col("n").alias("rows"), "positives", "k", "flipped", "auc", "_full",
        *[F.col(f"_border.{c}").alias(c) for c in at], F.col("_border.need").alias("_need"),
        F.col("_border.n").alias("_tied_n"), F.col("_border.pos").alias("_tied_pos"),
    )


def first_rows(ties: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """(keys, _tied): the positives among the first ``_need`` rows of each group."""
    placed = row_numbers(ties, keys, order, "_rn")
    return placed.groupBy(*keys).agg(
        F.sum(F.when(F.col("_rn") <= F.col("_need"), F.col(label).cast("long")).otherwise(0)).alias("_tied")
    )


def measured(groups: DataFrame, taken: DataFrame, keys: Sequence[str], normalise: bool = True) -> DataFrame:
    """The metrics per group, from what ``border`` and ``first_rows`` found."""
    border_hits = (
        F.when(F.col("_need").isNull() | (F.col("_tied_pos") == 0), F.lit(0))
        .when(F.col("_tied_pos") == F.col("_tied_n"), F.col("_need"))
        .otherwise(F.coalesce(F.col("_tied"), F.lit(0)))
    )
    out = join_keys(groups, taken, keys, "left").withColumnRenamed("rows", "n")
    out = out.withColumn("hits", (F.col("_full") + border_hits).cast("long")).withColumns(
        {
            "gini": F.lit(2.0) * F.col("auc") - 1,
            "recall": F.coalesce(ratio(F.col("hits"), F.col("positives")), F.lit(0.0)),
            "lift": F.coalesce(
                ratio(ratio(F.col("hits"), F.col("k")), ratio(F.col("positives"), F.col("n"))), F.lit(0.0)
            ),
        }
    )
    out = out.withColumn("composite", composite(F.col("gini"), F.col("recall"), F.col("lift"), normalise))
    return out.select(
        *keys, "n", "positives", "k", "hits", "auc", "gini", "recall", "lift", "composite", "flipped"
    )


def last_months(df: DataFrame, n: int, date: str = "ref_date") -> DataFrame:
    """Rows of the last ``n`` distinct months. The month list is small by nature."""
    month = month_start(F.col(date))
    months = df.select(month.alias("month")).distinct().orderBy(F.desc("month")).limit(n)
    return df.withColumn("month", month).join(materialize(months), "month")


def top_preview(df: DataFrame, score: str, ids: Sequence[str], n: int = 20) -> DataFrame:
    """Count, mean, median and deviation of the ``n`` highest scores; ties are taken in id order, null scores last."""
    first = df.orderBy(F.desc_nulls_last(score), *ids).limit(n)
    return first.agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median"), F.stddev_samp(score).alias("std")
    )


def month_priority(df: DataFrame, by: Sequence[str], weights: Mapping[str, float], date: str = "ref_date", **kw) -> DataFrame:
    """Weighted sum of the recalls of the months (first days) in ``weights``; null for a group that lacks one of them.

    Rows of other months are left out before anything is ranked.
    """
    month = month_start(F.col(date))
    rows = df.withColumn("month", month).where(month.cast("string").isin(list(weights)))
    recall = ranking_metrics(rows, [*by, "month"], **kw)
    parts = [F.lit(float(w)) * F.max(F.when(F.col("month").cast("string") == m, F.col("recall"))) for m, w in weights.items()]
    return recall.groupBy(*by).agg(reduce(lambda a, b: a + b, parts).alias("priority"))


def monthly_metrics(
    df: DataFrame, by: Sequence[str] = (), last_n: int | None = 6, score: str = "p", label: str = "y", **kw
) -> DataFrame:
    """Metrics per (``by``, month) after the per-month flip guard."""
    rows = last_months(df, last_n) if last_n else df.withColumn("month", month_start(F.col("ref_date")))
    return ranking_metrics(rows, [*by, "month"], score, label, flip=True, **kw)


def monthly_composite(df: DataFrame, by: Sequence[str] = (), last_n: int = 6, **kw) -> DataFrame:
    """Mean of the monthly composites."""
    months = monthly_metrics(df, by, last_n, **kw)
    return months.groupBy(*by).agg(F.avg("composite").alias("composite"), F.count(F.lit(1)).alias("months"))


def top_k(df: DataFrame, by: Sequence[str], score: str, ids: Sequence[str], share: float = TOP_SHARE,
          rounding: str = "half_even") -> DataFrame:
    """Rows in the top share of their group's scored rows, best first, ids deciding ties."""
    df, keys = _grouped(scored(df, score), by)
    placed = row_numbers(df, keys, [-F.col(score), *[F.col(c) for c in ids]], "rn")
    return placed.where(F.col("rn") <= top_rows(F.col("rn_total"), share, rounding)).drop("rn_total", "_all")


def score_summary(df: DataFrame, by: Sequence[str], score: str = "p") -> DataFrame:
    """Range, mean, population deviation and the 1st, 50th and 99th percentile of a score per group."""
    base = df.groupBy(*by).agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
    )
    q = percentiles(df, by, score, (0.01, 0.5, 0.99))
    parts = [F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p1", "p50", "p99"))]
    return join_keys(base, q, list(by), "left").select(*base.columns, *parts)


def score_histogram(df: DataFrame, by: Sequence[str], score: str = "p", bins: int = 10) -> DataFrame:
    """Counts and percentages in equal bins on [0, 1]; the last bin holds 1. Scores outside are not counted."""
    s = F.col(score)
    binned = df.where(s.between(0.0, 1.0)).withColumn("bin", F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    return join_keys(counts, totals, list(by)).select(*by, "bin", "n", (F.col("n") / F.col("_all") * 100).alias("pct"))


def fold_stability(scores: DataFrame, by: Sequence[str], order: str, score: str) -> DataFrame:
    """Deviation and trend of fold scores, and 1 / (1 + coefficient of variation). One row per fold comes in."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    std, mean = F.stddev_pop(score), F.avg(score)
    return scores.withColumn("_i", place.cast("double")).groupBy(*by).agg(
        std.alias("fold_std"),
        F.coalesce(F.regr_slope(score, "_i"), F.lit(0.0)).alias("score_trend"),
        (F.lit(1.0) / (F.lit(1.0) + std / (mean + F.lit(1e-9)))).alias("stability"),
    )
