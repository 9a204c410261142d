"""Pairwise feature interactions and the choice of features to cross."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.safe import fill, guarded_ratio, shifted_ratio

# Name parts that mark an interaction.
TOKENS = ("_X_", "_DIV_", "_PLUS_", "_MINUS_")


def cross(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Six columns per feature pair: product, sum, both differences, both ratios; gaps become the sentinel."""
    out = {}
    for a, b in combinations(features, 2):
        x, y = F.col(a), F.col(b)
        out[f"{a}_X_{b}"] = fill(x * y)
        out[f"{a}_PLUS_{b}"] = fill(x + y)
        out[f"{a}_MINUS_{b}"] = fill(x - y)
        out[f"{b}_MINUS_{a}"] = fill(y - x)
        out[f"{a}_DIV_{b}"] = fill(guarded_ratio(x, y))
        out[f"{b}_DIV_{a}"] = fill(guarded_ratio(y, x))
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def cross_simple(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The older three-column form: product and both ratios with a shifted denominator."""
    out = {}
    for a, b in combinations(features, 2):
        x, y = F.col(a), F.col(b)
        out[f"{a}_X_{b}"] = x * y
        out[f"{a}_DIV_{b}"] = shifted_ratio(x, y)
        out[f"{b}_DIV_{a}"] = shifted_ratio(y, x)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def plain_features(importance: DataFrame) -> DataFrame:
    """Importance rows whose feature is not itself an interaction or a key."""
    keep = ~F.col("feature").rlike("|".join(TOKENS)) & ~F.col("feature").isin("cust_id", "ref_date")
    return importance.where(keep)


def top_features(importance: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most important plain features, ties by name."""
    return plain_features(importance).orderBy(F.desc("importance_mean"), "feature").limit(n)


def top_by_variance(variances: DataFrame, n: int = 8) -> DataFrame:
    """Fallback when no importance is known: largest sample variance first."""
    return plain_features(variances).orderBy(F.desc_nulls_last("variance"), "feature").limit(n)
