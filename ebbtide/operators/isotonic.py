"""Isotonic fits of many groups in one job: segments, folds, or both.

Rows are counted per (group, score) first. Ranges of (group, score) are then pooled side by side: a run of scores becomes blocks of rising
means, and blocks of neighbouring ranges are pooled once more, which gives the same steps as pooling all scores in order. What passes one
task in the second round are a group's blocks, not its scores. Labels are 0 or 1, so the means are fractions of counts: a range of n rows has
no more than about 2 n^(2/3) blocks of different mean, and for scores that rank at all in the order of n^(1/3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = "g string, lo double, hi double, w double, wy double"
_SCHEMA = pa.schema([("g", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("w", pa.float64()), ("wy", pa.float64())])
OUT = 65_536


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of (g, lo), neighbours pooled until the means of a group rise strictly."""
    stack: list[tuple[float, float, float, float]] = []
    key, ready = None, []
    for b in batches:
        for g, lo, hi, w, wy in zip(*(b[c].to_pylist() for c in _SCHEMA.names)):
            if g != key:
                ready += [(key, *s) for s in stack]
                key, stack = g, []
            while stack and stack[-1][3] * w >= wy * stack[-1][2]:
                lo, _, w0, wy0 = stack.pop()
                w, wy = w + w0, wy + wy0
            stack.append((lo, hi, w, wy))
        while len(ready) >= OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready[:OUT]), _SCHEMA.types)], schema=_SCHEMA)
            ready = ready[OUT:]
    ready += [(key, *s) for s in stack]
    for i in range(0, len(ready), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready[i:i + OUT]), _SCHEMA.types)], schema=_SCHEMA)


def steps(points: DataFrame) -> DataFrame:
    """(g, lo, hi, w, value): the steps of every group's fit, from ``points`` (g string, p, y, w).

    Points without group, score or label, or whose score is not a number, take no part; nor do those of no weight.
    """
    counted = points.na.drop("any", subset=["g", "p", "y", "w"]).where("w > 0").groupBy("g", (F.col("p") + F.lit(0.0)).alias("lo")).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).select("g", "lo", F.col("lo").alias("hi"), "w", "wy")
    ranged = counted.repartitionByRange("g", "lo").sortWithinPartitions("g", "lo").mapInArrow(_pool, _BLOCKS)
    whole = ranged.repartition("g").sortWithinPartitions("g", "lo").mapInArrow(_pool, _BLOCKS)
    return whole.select("g", "lo", "hi", "w", (F.col("wy") / F.col("w")).alias("value"))


@dataclass
class Curves:
    """Fitted steps by group, as places and values; straight lines between steps, the end steps' values outside."""

    places: dict[str, np.ndarray]
    values: dict[str, np.ndarray]

    @staticmethod
    def of(table: DataFrame) -> Curves:
        """From :func:`steps`, which is collected: at most the blocks named above, per group."""
        at = table.select("g", "lo", "hi", "value").toPandas().sort_values(["g", "lo"])
        places, values = {}, {}
        for g, t in at.groupby("g", sort=False):
            places[g] = t[["lo", "hi"]].to_numpy(dtype=np.float64).ravel()
            values[g] = np.repeat(t["value"].to_numpy(dtype=np.float64), 2)
        return Curves(places, values)

    def table(self, spark) -> DataFrame:
        rows = [(g, float(x[i]), float(x[i + 1]), float(self.values[g][i])) for g, x in self.places.items() for i in range(0, len(x), 2)]
        return spark.createDataFrame(rows, "g string, lo double, hi double, value double")

    def at(self, group: Column, score: Column) -> Column:
        """The fit of ``group`` at ``score``; null without a score or a fitted group."""
        places, values = self.places, self.values

        @F.pandas_udf("double")
        def look(g: pd.Series, p: pd.Series) -> pd.Series:
            out, x = np.full(len(p), np.nan), p.to_numpy(dtype=np.float64, na_value=np.nan)
            for key, rows in g.groupby(g).indices.items():
                if key in places:
                    out[rows] = np.interp(x[rows], places[key], values[key])
            return pd.Series(out)

        return look(group.cast("string"), score.cast("double"))


def fit_curves(points: DataFrame) -> Curves:
    return Curves.of(steps(points))
