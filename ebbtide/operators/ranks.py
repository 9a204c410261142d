"""Exact ranks, running totals and order statistics that never gather a group into one task.

A plain window ordered over a month, a split or a whole table sorts the group inside a single task, and the
exact ``percentile`` aggregate keeps every distinct value of the group in one buffer. Here the group is cut
into key ranges first:

1. the cut points are evenly spaced values of a hash sample of the group's keys, so they follow any distribution
   and come out the same each time they are computed. The sample is thinned lot by lot, so no array exceeds
   ``LOTS * PER_LOT`` values or one row in ``SAMPLE_ONE_IN * LOTS``;
   Groups with fewer than ``MIN_SAMPLED`` sampled keys (some tens of thousands of distinct keys) stay in one range;
2. ranges are totalled; the totals of one group (at most ``RANGES`` rows) are accumulated;
3. rows are accumulated inside their range and lifted by the range's offset.

Ranks, running sums and percentiles are exact, whatever the cut points are. A null in a group key is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.runtime import materialize

RANGES = 512
SAMPLE_ONE_IN = 4096
LOTS = 1024
PER_LOT = 64
MIN_SAMPLED = 16
SALTS = 32


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys come from the left side, once."""
    renamed = right.select(*[F.col(c).alias(f"_join_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_join_{k}"])
    return left.join(renamed, same, how).drop(*[f"_join_{k}" for k in keys])


def _thinned(array: str, n: int) -> Column:
    """At most ``n`` evenly spaced elements of a sorted array."""
    size = F.size(array)
    every = F.transform(
        F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.element_at(array, F.floor(i * size / n).cast("int") + 1)
    )
    return F.when(size <= n, F.col(array)).otherwise(every)


def _cuts(df: DataFrame, by: Sequence[str], key: str) -> DataFrame | None:
    """Cut points per group, for the groups large enough to need any; ``None`` when there is no such group.

    The sample is a condition on the key, so it is applied before the rows are counted or shuffled. The result is
    small (at most ``RANGES`` values per large group) and written out, so the planner knows its size.
    """
    sample = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(SAMPLE_ONE_IN)) == 0)
    lots = sample.groupBy(*by, F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(LOTS)).alias("_lot"))
    thin = lots.agg(F.sort_array(F.collect_set(key)).alias("_s")).select(*by, _thinned("_s", PER_LOT).alias("_s"))
    cuts = thin.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("_s"))).alias("_s"))
    cuts = cuts.where(F.size("_s") >= MIN_SAMPLED).select(*by, _thinned("_s", RANGES).alias("_cuts"))
    made = materialize(cuts)
    return None if made.isEmpty() else made


def _below(cuts: str, key: str) -> Column:
    """How many of the sorted cut points lie below the key, by halving: a row is compared with ten of them, not with all."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col(cuts), at + step - 1) < F.col(key), at + step).otherwise(at))


def _with_range(df: DataFrame, by: Sequence[str], key: str, cuts: DataFrame) -> DataFrame:
    """Add ``_range``: the number of the group's cut points below the key."""
    # Should the cut points be too large to broadcast, the salt spreads a group that holds most of the rows over
    # several tasks of the join.
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(SALTS)).cast("int"))
    joined = join_keys(salted, cuts, [*by, "_salt"], "left")
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_below("_cuts", key))).drop("_salt", "_cuts")


def running_totals(df: DataFrame, by: Sequence[str], key: str, sums: Sequence[str]) -> DataFrame:
    """Running and whole-group totals of ``sums`` in ascending order of ``key``.

    ``df`` has one row per (by, key). For each column ``c`` adds ``c_before`` (rows with a smaller key) and
    ``c_total`` (the whole group).
    """
    by = list(by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cuts = _cuts(df, by, key)
    if cuts is None:
        # No group is large: each one is ordered as it is.
        upto = group.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = group.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            *df.columns,
            *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before") for c in sums],
            *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
        )
    # Written, as two branches read it: the ranges of all rows are looked up once.
    ranged = materialize(_with_range(df, by, key, cuts))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # At most RANGES rows per group reach this window.
    upto = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *by,
        "_range",
        *[(F.sum(f"_t_{c}").over(upto) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    inner = (
        Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = join_keys(ranged, offsets, [*by, "_range"])
    for c in sums:
        out = out.withColumn(f"_r_{c}", F.sum(c).over(inner))
    return out.select(
        *df.columns,
        *[(F.col(f"_r_{c}") - F.col(c) + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Row number 1..n inside each group and the group size ``<name>_total``.

    ``order`` must identify a row of the group: end it with an id. For a descending number pass its negative.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).withColumn(
        name, F.lit(1).cast("long")
    )
    # Written, as the cut points and the ranges read them: what the rows come from is worked out once.
    out = running_totals(materialize(keyed), by, "_key", [name])
    return out.withColumn(name, F.col(f"{name}_before") + 1).drop("_key", f"{name}_before")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of ``value`` (ties share the mean of their places) and the group size ``<name>_total``.

    Ties are counted before anything is ordered, so the ordered table holds distinct values only. Rows with a
    null value get a null rank and are not counted.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counts, by, value, ["n"]).select(
        *by,
        value,
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name),
        F.col("n_total").alias(f"{name}_total"),
    )
    return join_keys(df, ranked, [*by, value], "left").select(*df.columns, name, f"{name}_total")


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], name: str = "q", count: str | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles per group as an array column in the order of ``probs``."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, by, value, ["n"])
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}{i}"))
    out = placed.groupBy(*by).agg(F.max("n_total").alias("_n"), *aggs)
    parts = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        parts.append(lo + (h - F.floor(h)) * (hi - lo))
    extra = [F.col("_n").alias(count)] if count else []
    return out.select(*by, F.array(*parts).alias(name), *extra)
