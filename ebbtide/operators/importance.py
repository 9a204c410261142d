"""Feature-importance tables: roll-ups, categories, removal and interaction advice.

Importance tables have one row per feature (and fold or model), so they are small; they stay DataFrames all the
same and are joined and ranked by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.safe import shifted_ratio

# Categories in match order.
CATEGORIES = (
    ("interaction", r"_x_|\*"),
    ("ratio", r"_div_|/|_per_"),
    ("rfm", r"recency|frequency|monetary|rfm_"),
    ("behavioral", r"change_|delta_|trend_|volatility"),
    ("lifecycle", r"lifecycle|tenure|stage|adoption"),
    ("time_based", r"days_|months_|years_|date|time|last_|first_"),
    ("aggregation", r"mean|sum|max|min|std|count|total|avg"),
    ("advanced", r"intensity|consistency|decay|gap|peak"),
)
LEVELS = ((0.2, "Very Consistent"), (0.5, "Consistent"), (1.0, "Moderate"))


def roll_up(df: DataFrame, method: str = "mean") -> DataFrame:
    """Per feature over models: the chosen statistic, deviation, extremes, count, consistency and rank."""
    fn = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[method]
    name = f"importance_{method}"
    aggs = {
        name: fn("importance"),
        "importance_std": F.stddev_samp("importance"),
        "importance_min": F.min("importance"),
        "importance_max": F.max("importance"),
        "num_models": F.count("importance"),
    }
    out = df.groupBy("feature").agg(*[c.alias(n) for n, c in aggs.items()])
    out = out.withColumn("consistency", shifted_ratio(F.col(name), F.col("importance_std"), 1e-6))
    # One row per feature name: the list is as short as the feature set.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(name), "feature")
    return out.withColumn("rank", F.row_number().over(order))


def across_folds(df: DataFrame, folds: list[str]) -> DataFrame:
    """(feature, fold, gain) to one column per fold, zero where absent, with mean and sample deviation."""
    wide = df.groupBy("feature").pivot("fold", folds).agg(F.sum("gain")).fillna(0.0)
    renamed = wide.select("feature", *[F.col(f).alias(f"importance_fold_{f}") for f in folds])
    cols = [F.col(f"importance_fold_{f}") for f in folds]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    mean = total / F.lit(float(len(folds)))
    squares = F.aggregate(F.array(*cols), F.lit(0.0), lambda acc, x: acc + (x - F.col("importance_mean")) ** 2)
    out = renamed.withColumn("importance_mean", mean)
    if len(folds) < 2:
        return out.withColumn("importance_std", F.lit(0.0))
    return out.withColumn("importance_std", F.sqrt(squares / F.lit(float(len(folds) - 1))))


def category(feature: Column) -> Column:
    name = F.lower(feature)
    out = None
    for label, pattern in CATEGORIES:
        out = F.when(name.rlike(pattern), F.lit(label)) if out is None else out.when(name.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("basic"))


def consistency_level(std: Column, mean: Column) -> Column:
    cv = shifted_ratio(std, mean, 1e-6)
    out = None
    for limit, label in LEVELS:
        out = F.when(cv < limit, F.lit(label)) if out is None else out.when(cv < limit, F.lit(label))
    return out.otherwise(F.lit("Inconsistent"))


def category_share(rolled: DataFrame, top_n: int = 50) -> DataFrame:
    """Number and percentage of each category among the top features."""
    top = rolled.where(F.col("rank") <= top_n).groupBy(category(F.col("feature")).alias("category"))
    return top.agg(F.count(F.lit(1)).alias("features")).withColumn("pct", F.col("features") / top_n * 100)


def removal_list(pairs: DataFrame, importance: DataFrame, threshold: float = 0.001) -> DataFrame:
    """The weaker feature of each redundant pair (the second on a tie), and every feature of low importance."""
    imp = importance.select("feature", "importance_mean")
    left = imp.withColumnsRenamed({"feature": "a", "importance_mean": "ia"})
    right = imp.withColumnsRenamed({"feature": "b", "importance_mean": "ib"})
    zero = F.lit(0.0)
    weaker = pairs.join(left, "a", "left").join(right, "b", "left").select(
        F.when(F.coalesce("ia", zero) < F.coalesce("ib", zero), F.col("a")).otherwise(F.col("b")).alias("feature"),
    )
    low = imp.where(F.col("importance_mean") < threshold).select("feature")
    return weaker.unionByName(low).distinct()


def feature_pairs(features: DataFrame) -> DataFrame:
    """All pairs of a short feature list in rank order, built inside one array (no self-join)."""
    ordered = features.agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("f"))
    first = ordered.select("f", F.posexplode("f").alias("i", "x"))
    rest = F.slice("f", F.col("i") + 2, F.size("f"))
    return first.select(F.col("x.feature").alias("a"), F.explode(rest).alias("y")).select(
        "a", F.col("y.feature").alias("b")
    )


def crossed_pairs(features: DataFrame) -> DataFrame:
    """Pairs an existing interaction name already covers, lower case and sorted."""
    parts = F.split(F.regexp_replace(F.lower("feature"), "_x_", "*"), r"\*")
    is_cross = F.lower("feature").rlike(r"_x_|\*")
    return (
        features.where(is_cross).select(F.sort_array(parts).alias("p")).where(F.size("p") == 2)
        .select(F.try_element_at("p", F.lit(1)).alias("x"), F.try_element_at("p", F.lit(2)).alias("y")).distinct()
    )


def new_interactions(rolled: DataFrame, top_n: int = 10) -> DataFrame:
    """Pairs of the best plain features that no interaction covers yet."""
    base = (
        rolled.where((F.col("rank") <= 2 * top_n) & ~F.lower("feature").rlike(r"_x_|\*|_div_"))
        .orderBy("rank").limit(top_n)
    )
    pairs = feature_pairs(base).withColumns(
        {"x": F.least(F.lower("a"), F.lower("b")), "y": F.greatest(F.lower("a"), F.lower("b"))}
    )
    return pairs.join(crossed_pairs(rolled), ["x", "y"], "left_anti").select("a", "b")


def stable_features(gains: DataFrame, presence: float = 0.7, cv: float = 1.0, floor: float = 0.001) -> DataFrame:
    """Features whose normalised gain is important in most splits, steady and not negligible.

    ``gains`` has (feature, split, gain); gains are scaled to sum one inside a split and an absent row is zero.
    """
    total = gains.groupBy("split").agg(F.sum("gain").alias("t"))
    norm = gains.join(total, "split").withColumn("g", F.col("gain") / (F.col("t") + F.lit(1e-9)))
    stats = norm.groupBy("feature").agg(
        F.count_if(F.col("g") > floor).alias("strong"), F.sum("g").alias("g1"), F.sum(F.col("g") * F.col("g")).alias("g2")
    )
    stats = stats.withColumn("splits", total.agg(F.count(F.lit(1)).cast("double")).scalar())
    mean = F.col("g1") / F.col("splits")
    stats = stats.select(
        "feature",
        (F.col("strong") / F.col("splits")).alias("presence"),
        mean.alias("mean_gain"),
        F.sqrt(F.greatest(F.col("g2") / F.col("splits") - mean * mean, F.lit(0.0))).alias("std_gain"),
    )
    stats = stats.withColumn("cv", shifted_ratio(F.col("std_gain"), F.col("mean_gain"), 1e-9))
    keep = (F.col("presence") >= presence) & (F.col("cv") < cv) & (F.col("mean_gain") > floor)
    return stats.withColumn("stable", keep)
