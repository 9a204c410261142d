"""Column profiles, cleaning, validation, leakage and drift statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import safe

# Fixed values.
SUSPICIOUS = ("_future_", "_next_", "_after_", "forward_", "_ahead_")
DATE_NAMES = ("window_end", "end_date", "period_end", "date", "month", "month_end", "window_end_date")
MAX_LABEL_CORR = 0.9
MAX_SHIFT = 3.0
MAX_NULL_GAP = 0.3
KEY_NAMES = ("cust_id", "ref_date", "churn", "split")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = KEY_NAMES) -> list[str]:
    kinds = ("double", "float", "integer", "long", "short", "byte", "decimal")
    return [f.name for f in df.schema if f.dataType.typeName() in kinds and f.name not in exclude]


def drop_like(df: DataFrame, part: str = "religion") -> DataFrame:
    """Without the columns whose name contains ``part``."""
    return df.drop(*[c for c in df.columns if part in c.lower()])


def map_columns(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def fill_all(df: DataFrame, value: float = safe.SENTINEL) -> DataFrame:
    """Nulls, NaN and infinities of every numeric feature become the sentinel."""
    return map_columns(df, numeric_columns(df), lambda c: safe.fill(c, value))


def align(train: DataFrame, test: DataFrame, how: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Give both sides the same columns: ``raise`` on a difference, ``common`` only, or ``zero`` for missing ones."""
    a, b = train.columns, test.columns
    if how == "raise":
        missing, extra = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        if missing or extra:
            raise ValueError(f"columns differ: missing in test {missing}, extra in test {extra}")
        return train, test.select(*a)
    if how == "common":
        keep = [c for c in a if c in set(b)]
        return train.select(*keep), test.select(*keep)
    return train, test.select(*[F.col(c) if c in b else F.lit(0.0).alias(c) for c in a])


def sample_rows(df: DataFrame, ids: Sequence[str], n: int = 20_000, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows without replacement: the smallest hashes of the id."""
    h = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    return df.orderBy(h, *ids).limit(n)


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature). Follow with an aggregate: partial sums shrink it before the shuffle."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    return df.select(*keep, F.inline(entries))


def profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls, mean, sample deviation and variance per (by, feature)."""
    return long_form(df, columns, by).groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.var_samp("x").alias("variance"),
    )


def with_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sides stacked with ``domain`` 0 (train) and 1 (test)."""
    return train.withColumn("domain", F.lit(0)).unionByName(
        test.withColumn("domain", F.lit(1)), allowMissingColumns=True
    )


def mean_shift(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """|mean difference| over the sum of both deviations per feature; small is stable."""
    p = profile(with_split(train, test), columns, ["domain"])
    side = p.groupBy("feature").agg(
        *[F.max(F.when(F.col("domain") == d, F.col(c))).alias(f"{c}{d}") for d in (0, 1) for c in ("mean", "std")]
    )
    gap = F.abs(F.col("mean0") - F.col("mean1"))
    return side.select("feature", safe.ratio(gap, F.col("std0") + F.col("std1")).alias("shift"))


def leakage_report(
    train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "churn"
) -> DataFrame:
    """Per feature: correlation with the label, shift of the mean, null-rate gap, suspicious name; and the flags."""
    y = F.col(label).cast("double") if label in train.columns else F.lit(None).cast("double")
    both = with_split(train.withColumn("_y", y), test)
    stats = long_form(both, columns, ["domain", "_y"]).groupBy("feature").agg(
        F.corr(F.when(F.col("domain") == 0, F.col("x")), F.when(F.col("domain") == 0, F.col("_y"))).alias("label_corr"),
        *[F.avg(F.when(F.col("domain") == d, F.col("x"))).alias(f"m{d}") for d in (0, 1)],
        F.stddev_samp(F.when(F.col("domain") == 0, F.col("x"))).alias("s0"),
        *[
            F.avg(F.when(F.col("domain") == d, F.col("x").isNull().cast("double"))).alias(f"z{d}")
            for d in (0, 1)
        ],
    )
    shift = F.when(F.col("s0") > 1e-6, F.abs(F.col("m1") - F.col("m0")) / F.col("s0"))
    out = stats.select(
        "feature",
        F.nanvl(F.col("label_corr"), F.lit(None)).alias("label_corr"),
        shift.alias("shift"),
        F.abs(F.col("z0") - F.col("z1")).alias("null_gap"),
        suspicious_name(F.col("feature")).alias("suspicious"),
    )
    flagged = (
        F.coalesce(F.abs("label_corr") > MAX_LABEL_CORR, F.lit(False))
        | F.coalesce(F.col("shift") > MAX_SHIFT, F.lit(False))
        | F.coalesce(F.col("null_gap") > MAX_NULL_GAP, F.lit(False))
        | F.col("suspicious")
    )
    return out.withColumn("flagged", flagged)


def suspicious_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SUSPICIOUS))


def future_rows(df: DataFrame, ref: Column, columns: Sequence[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Per date column, how many values lie at or after the reference date, and the latest value.

    ``inclusive=False`` lets the reference date itself pass, as the ``<= ref`` windows do.
    """
    if columns is None:
        columns = [c for c in DATE_NAMES if c in df.columns] or [
            f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp")
        ]
    rows = []
    for c in columns:
        end = F.last_day(F.to_date(F.col(c))) if c == "month" else F.col(c).cast("date")
        rows.append(F.struct(F.lit(c).alias("column"), end.alias("d")))
    long = df.select(ref.cast("date").alias("_ref"), F.inline(F.array(*rows)))
    bad = F.col("d") >= F.col("_ref") if inclusive else F.col("d") > F.col("_ref")
    return long.groupBy("column").agg(F.count_if(bad).alias("violations"), F.max("d").alias("max_seen"))


def assert_no_future(df: DataFrame, ref: Column, columns: Sequence[str] | None = None, inclusive: bool = True) -> None:
    """Raise when ``future_rows`` finds any."""
    found = future_rows(df, ref, columns, inclusive).where("violations > 0").collect()
    if found:
        text = ", ".join(f"{r.column} (n={r.violations}, max={r.max_seen})" for r in found)
        raise ValueError(f"values not before the reference date: {text}")


def output_check(df: DataFrame, id_col: str = "cust_id", score: str = "churn") -> DataFrame:
    """One row: counts, nulls, range and whether the scored output may be published."""
    for c in (id_col, score):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
    s = F.col(score)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(id_col).isNull() | s.isNull() | F.isnan(s)).alias("nulls"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
    )
    ok = (F.col("nulls") == 0) & (F.col("min_score") >= 0) & (F.col("max_score") <= 1)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def label_summary(df: DataFrame, label: str = "churn") -> DataFrame:
    return df.agg(F.avg(label).alias("prevalence"), F.count_if(F.col(label).isNull()).alias("missing_labels"))


def domain_weight(p: Column, kind: str = "sigmoid") -> Column:
    """Row weight from the probability of belonging to the scoring cohort."""
    if kind == "sigmoid":
        return safe.clip(safe.sigmoid(F.lit(-2.0) * (p - F.lit(0.5))), 0.8, 1.2)
    if kind == "complement":
        return safe.clip(F.lit(1.0) - p, 0.9, 1.1)
    raise ValueError(kind)


def odds(p: Column, eps: float = 1e-6) -> Column:
    q = safe.clip(p, eps, 1.0 - eps)
    return q / (F.lit(1.0) - q)


def in_years(df: DataFrame, first: int, last: int, date: str = "ref_date") -> DataFrame:
    """Rows whose date lies in the given years; a range on the column, so partitions and files are skipped."""
    d = F.col(date)
    return df.where((d >= F.lit(f"{first}-01-01").cast("date")) & (d < F.lit(f"{last + 1}-01-01").cast("date")))
