"""Time-aware and stratified folds, and row weights.

Month folds are decided on the list of distinct months (a calendar's worth of rows) and joined back to the rows.
A fold table has the columns (fold, role, month); ``month`` is the first day of the month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.periods import month_number, month_start
from ebbtide.operators.ranks import join_keys, row_numbers
from ebbtide.runtime import materialize

# Fixed values.
MIN_TRAIN_MONTHS = 6
WEIGHT_FLOOR = 1e-6


def _month_list(df: DataFrame, date: str = "ref_date") -> DataFrame:
    """One row holding the sorted array of (month, rows)."""
    counts = df.groupBy(month_start(F.col(date)).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sort_array(F.collect_list(F.struct("month", "n"))).alias("months"))


def _tail(n: int) -> Column:
    size = F.size("months")
    return F.slice("months", F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def _roles(valid: DataFrame) -> DataFrame:
    """(fold, train, valid) arrays to (fold, role, month) rows; folds with an empty side are dropped."""
    both = valid.where((F.size("train") > 0) & (F.size("valid") > 0))
    role = F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("train").alias("m")),
                             F.struct(F.lit("valid").alias("role"), F.col("valid").alias("m")))).alias("x")
    return both.select("fold", role).select("fold", "x.role", F.explode("x.m").alias("m")).select(
        "fold", "role", F.col("m.month").alias("month")
    )


def month_folds(df: DataFrame, last_n: int = 6, gap: int = 1) -> DataFrame:
    """Each of the last months validates; months at least ``gap + 1`` earlier train."""
    v = _month_list(df).select("months", F.explode(_tail(last_n)).alias("v"))
    far = F.filter("months", lambda m: month_number(F.col("v.month")) - month_number(m["month"]) >= gap + 1)
    return _roles(v.select(F.col("v.month").alias("fold"), far.alias("train"), F.array("v").alias("valid")))


def expanding_folds(df: DataFrame, last_n: int = 6, min_rows: int = 500) -> DataFrame:
    """All earlier months train; both sides need ``min_rows`` rows."""
    v = _month_list(df).select("months", F.explode(_tail(last_n)).alias("v"))
    before = F.filter("months", lambda m: m["month"] < F.col("v.month"))
    rows = F.aggregate(before, F.lit(0).cast("long"), lambda acc, m: acc + m["n"])
    return _roles(
        v.where((rows >= min_rows) & (F.col("v.n") >= min_rows)).select(
            F.col("v.month").alias("fold"), before.alias("train"), F.array("v").alias("valid")
        )
    )


def rolling_folds(df: DataFrame, n_splits: int = 5, test_months: int = 3, gap: int = 1) -> DataFrame:
    """Blocks of ``test_months`` months validate, ``gap`` months before a block are left out, all before them train.

    Block i ends i steps before the last month, the step being an even share of the months that are free to move
    over. Blocks with fewer than ``MIN_TRAIN_MONTHS`` months to train on do not count; the earliest left is fold 0. Too
    few months for any block are an error.
    """
    size = F.size("months")
    step = F.greatest(F.floor((size - gap - MIN_TRAIN_MONTHS) / (n_splits + 1)).cast("int"), F.lit(1))
    spare = size - test_months - gap - MIN_TRAIN_MONTHS
    count = F.least(F.floor(spare / step).cast("int") + 1, F.lit(n_splits))
    enough = F.when(spare >= 0, count).otherwise(F.raise_error(F.lit("rolling_folds: too few months for one block")).cast("int"))
    blocks = _month_list(df).select("months", step.alias("step"), enough.alias("count"))
    blocks = blocks.select("months", "step", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    train = size - F.col("i") * F.col("step") - test_months - gap
    return _roles(blocks.select(
        (F.col("count") - 1 - F.col("i")).alias("fold"), F.slice("months", F.lit(1), train).alias("train"),
        F.slice("months", train + gap + 1, F.lit(test_months)).alias("valid")))


def named_month_holdout(df: DataFrame, months: Sequence[str]) -> DataFrame:
    """A named month validates and every other month trains. Later months leak into training: use by name only."""
    v = _month_list(df).select("months", F.explode("months").alias("v"))
    v = v.where(F.col("v.month").isin(*[F.lit(m).cast("date") for m in months]))
    rest = F.filter("months", lambda m: m["month"] != F.col("v.month"))
    return _roles(v.select(F.col("v.month").alias("fold"), rest.alias("train"), F.array("v").alias("valid")))


def assign(df: DataFrame, folds: DataFrame, date: str = "ref_date") -> DataFrame:
    """Rows with their (fold, role); a row appears once per fold it takes part in."""
    return df.withColumn("month", month_start(F.col(date))).join(materialize(folds), "month")


def _hash_text(ids: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def _hash_number(ids: Sequence[str], seed: int) -> Column:
    return F.conv(F.substring(_hash_text(ids, seed), 1, 8), 16, 10).cast("long")


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1, the same share of each class in every fold (sizes differ by one at most)."""
    placed = row_numbers(df.withColumn("_h", _hash_text(ids, seed)), [label], [F.col("_h"), *map(F.col, ids)], "_rn")
    return placed.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn", "_rn_total")


def stratified_group_folds(df: DataFrame, label: str, group: str, k: int = 5) -> DataFrame:
    """Add ``fold`` 0..k-1 so that no group is split and every fold has its share of each class.

    Groups go largest first to the fold that is least filled, a fold's filling being the sum of its shares of the classes; ties go to the
    group and the fold that come first. Groups are as few as months: their counts per class come to the driver. With at least ``k``
    groups no fold stays empty. Rows without a label are placed with their group; a null group is a group.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).collect()
    totals = sum(r.pos for r in counts) or 1, sum(r.neg for r in counts) or 1
    filled, at = [0.0] * k, []
    for r in sorted(counts, key=lambda r: (-r.n, r[group] is not None, r[group])):
        fold = filled.index(min(filled))
        filled[fold] += r.pos / totals[0] + r.neg / totals[1]
        at.append((r[group], fold))
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(at, f"`{group}` {kind}, fold int")
    return join_keys(df, table, [group])


def grouped_folds(df: DataFrame, domain: str, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of domain 0 fold by month, so a month is never split; rows of domain 1 fold by id."""
    by_month = _hash_number(["month"], seed) % k
    by_id = _hash_number(ids, seed) % k
    out = df.withColumn("month", month_start(F.col("ref_date")))
    return out.withColumn("fold", F.when(F.col(domain) == 0, by_month).otherwise(by_id).cast("int"))


def forward_tiles(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Add ``tile``: 0 for the rows only ever trained on, then 1..k equal blocks in row order."""
    placed = row_numbers(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], "_rn")
    size = F.floor(F.col("_rn_total") / (k + 1))
    start = F.col("_rn_total") - size * k
    tile = F.when(F.col("_rn") <= start, F.lit(0)).otherwise(F.floor((F.col("_rn") - 1 - start) / size) + 1)
    return placed.withColumn("tile", tile.cast("int")).drop("_all", "_rn", "_rn_total")


def decay_weights(df: DataFrame, folds: DataFrame, lam: float | None = 0.2) -> DataFrame:
    """Training rows with ``w = exp(-lam * months)`` scaled to mean one within the fold; one everywhere if off.

    The weight depends on (fold, month) only, so the mean comes from month counts and no row is shuffled.
    """
    train = materialize(folds.where("role = 'train'"))
    rows = df.withColumn("month", month_start(F.col("ref_date")))
    if not lam or lam <= 0:
        return rows.join(train, "month").withColumn("w", F.lit(1.0))
    counts = rows.groupBy("month").agg(F.count(F.lit(1)).alias("n")).join(train, "month")
    raw = F.exp(F.lit(-float(lam)) * (month_number(F.col("fold")) - month_number(F.col("month"))))
    mean = counts.groupBy("fold").agg((F.sum(raw * F.col("n")) / F.sum("n")).alias("_mean"))
    table = materialize(train.join(mean, "fold").withColumn("w", raw / F.col("_mean")).drop("_mean"))
    return rows.join(table, "month")


def clean_weight(w: Column) -> Column:
    """NaN, null and infinities become one; nothing below a small floor."""
    d = w.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.greatest(F.when(bad, F.lit(1.0)).otherwise(d), F.lit(WEIGHT_FLOOR))


def base_score(df: DataFrame, by: Sequence[str], label: str = "y", weight: str = "w") -> DataFrame:
    """Weighted prevalence."""
    w = clean_weight(F.col(weight))
    return df.groupBy(*by).agg((F.sum(w * F.col(label)) / F.sum(w)).alias("base_score"))


def class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive."""
    pos = F.sum(F.col(label).cast("long"))
    return df.agg(F.try_divide((F.count(label) - pos).cast("double"), pos.cast("double")).alias("class_weight"))
