"""Quantile bins of a column as segment numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.features.rfm import bin_code, inner_edges
from ebbtide.operators.ranks import percentiles
from ebbtide.runtime import materialize


def quantile_segments(df: DataFrame, column: str, name: str, q: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the zero-based quantile bin of ``column``; missing values count as the median.

    Repeated edges collapse, so there may be fewer than ``q`` bins; a constant column has none (null).
    """
    by = list(by)
    probs = [i / q for i in range(q + 1)]
    median = materialize(percentiles(df, by, column, [0.5], "_m"))
    joined = df.join(median, by, "left") if by else df.withColumn("_m", median.scalar())
    filled = joined.withColumn("_x", F.coalesce(F.col(column).cast("double"), F.element_at("_m", 1)))
    edges = materialize(percentiles(filled, by, "_x", probs, "_e"))
    binned = filled.join(edges, by, "left") if by else filled.withColumn("_e", edges.scalar())
    code = bin_code(F.col("_x"), *inner_edges(F.col("_e")))
    return binned.withColumn(name, code.cast("int")).drop("_m", "_x", "_e")
