"""Exact percentiles of many columns per group, without laying the columns out as rows.

1. a bounded sample of each group places cut points per column, which cut it into ranges of about equal size;
2. one pass counts the rows per (group, column, range), once a task;
3. the counts tell which ranges hold the wanted places. A second pass returns only the values of those ranges, counted per distinct
   value, and they are ordered inside their range.

What is shuffled is a few percent of the values, whatever the number of columns; no range, whatever the group's size, holds more
distinct values than about one in ``RANGES``. Groups are as few as reference dates: their counts per range come to the driver. The cut
points only decide how evenly the work is dealt; the percentiles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
SAMPLE_ROWS = 4096
"""Rows of a group that place the cut points: those with the least hashes."""
PER_PERCENTILE = 16
"""Ranges for each percentile asked, where all rows are one group."""


def _cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Different values that cut a sample into even parts; a value that fills several parts is cut off on both sides."""
    known = np.sort(values[~np.isnan(values)])
    if not len(known):
        return np.empty(0)
    places = (np.arange(1, ranges) * len(known)) // ranges
    picked, often = np.unique(known[places], return_counts=True)
    heavy = picked[often > 1]
    return np.unique(np.concatenate([picked, np.nextafter(heavy[np.isfinite(heavy)], np.inf)]))


def _columns(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, group of its values, values that are not null)."""
    group = batch["_g"].to_numpy(zero_copy_only=False)
    for i in range(n):
        x = batch[f"c{i}"]
        given = np.asarray(x.is_valid())
        # Zero has one sign, as it has in a comparison of expressions.
        yield i, group[given], x.drop_null().to_numpy(zero_copy_only=False) + 0.0


def _count(batches: Iterator[pa.RecordBatch], cuts: list[list[np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, group, x in _columns(batch, n):
            for g in np.unique(group):
                edges = cuts[g][i]
                counts = np.bincount(np.searchsorted(edges, x[group == g], side="right"), minlength=len(edges) + 1)
                total[g, i] = total[g, i] + counts if (g, i) in total else counts
    if total:
        rows = [(g, i, r, c) for (g, i), counts in total.items() for r, c in enumerate(counts.tolist()) if c]
        g, i, r, c = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int32()), "i": pa.array(i, pa.int32()), "r": pa.array(r, pa.int32()), "n": pa.array(c, pa.int64())})


def _pick(batches: Iterator[pa.RecordBatch], cuts: list[list[np.ndarray]], wanted: dict[tuple[int, int], np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """The values of the wanted ranges, each with its count in the batch."""
    for batch in batches:
        for i, group, x in _columns(batch, n):
            for g in np.unique(group):
                if (g, i) not in wanted:
                    continue
                mine = x[group == g]
                spot = np.searchsorted(cuts[g][i], mine, side="right")
                inside = np.isin(spot, wanted[g, i])
                values, at, often = np.unique(mine[inside], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array(np.full(len(values), g), pa.int32()), "i": pa.array(np.full(len(values), i), pa.int32()),
                    "r": pa.array(spot[inside][at], pa.int32()), "x": pa.array(values, pa.float64()), "n": pa.array(often, pa.int64())})


def column_percentiles(df: DataFrame, by: str | None, values: Mapping[str, Column], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles: one row per value of ``by`` with columns ``q:<name>`` (array in the order of ``probs``) and ``n:<name>``.

    Nulls are not counted; a column without values in a group has a null array and a null count. NaN is above all numbers. A null in
    ``by`` is a group like any other. Without ``by`` all rows are one group and its row has no key; many percentiles are then cut into
    as many more ranges, so that what is picked stays a small share.
    """
    spark, names = df.sparkSession, list(values)
    ranges = RANGES if by else max(RANGES, PER_PERCENTILE * len(probs))
    rows = SAMPLE_ROWS * ranges // RANGES
    wide = df.select((F.col(by) if by else F.lit(0)).alias("_by"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(values.values())])
    columns = [f"c{i}" for i in range(len(names))]
    hashed = wide.withColumn("_h", F.xxhash64(*columns))
    if by:
        place = F.row_number().over(Window.partitionBy("_by").orderBy("_h"))
        some = hashed.withColumn("_p", place).where(F.col("_p") <= rows).drop("_h", "_p").toArrow()
    else:  # no sort: each task keeps its least
        some = hashed.orderBy("_h").limit(rows).drop("_h").toArrow()
    keys = some["_by"].unique()
    groups = keys.to_pylist()
    code = {k: g for g, k in enumerate(groups)}
    at = np.array([code[k] for k in some["_by"].to_pylist()], dtype=np.int64)
    sample = [some[c].to_numpy() for c in columns]
    cuts = [[_cuts(x[at == g].astype(np.float64), ranges) for x in sample] for g in range(len(groups))]
    sent = spark.sparkContext.broadcast(cuts)

    index = F.lit(0)
    for k, g in code.items():
        index = F.when(F.col("_by").eqNullSafe(F.lit(k)), F.lit(g)).otherwise(index)
    coded = wide.withColumn("_g", index).drop("_by")
    counted = coded.mapInArrow(lambda b: _count(b, sent.value, len(columns)), "g int, i int, r int, n long").groupBy("g", "i", "r").agg(F.sum("n").alias("n"))
    sizes = {(g, i): np.zeros(len(cuts[g][i]) + 1, dtype=np.int64) for g in range(len(groups)) for i in range(len(names))}
    for r in counted.toArrow().to_pylist():  # one number a group, column and range
        sizes[r["g"], r["i"]][r["r"]] = r["n"]

    wanted, targets = {}, []
    for (g, i), size in sizes.items():
        n, upto = int(size.sum()), np.cumsum(size)
        places = sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) if n else []
        if places:
            r = np.searchsorted(upto, places, side="right")
            wanted[g, i] = np.unique(r)
            targets += [(g, i, int(r_), int(t - (upto[r_ - 1] if r_ else 0)), t) for r_, t in zip(r, places)]
    picked = coded.mapInArrow(lambda b: _pick(b, sent.value, wanted, len(columns)), "g int, i int, r int, x double, n long")
    counts = picked.groupBy("g", "i", "r", "x").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "i", "r").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = spark.createDataFrame(targets, "tg int, ti int, tr int, within long, place long")
    placed = counts.withColumn("_upto", upto)
    here = (F.col("g") == F.col("tg")) & (F.col("i") == F.col("ti")) & (F.col("r") == F.col("tr"))
    here = here & (F.col("_upto") - F.col("n") <= F.col("within")) & (F.col("within") < F.col("_upto"))
    # One value for each group, column and place.
    found = {(r["g"], r["i"], r["place"]): r["x"] for r in placed.join(F.broadcast(asked), here).select("g", "i", "place", "x").toArrow().to_pylist()}

    rows = []
    for g, key in enumerate(groups):
        row = [key] if by else []
        for i in range(len(names)):
            n = int(sizes[g, i].sum())
            q = None
            if n:
                q = []
                for p in probs:
                    h = float(p) * (n - 1)
                    low, high = found[g, i, math.floor(h)], found[g, i, math.ceil(h)]
                    q.append(low if low == high else low + (h - math.floor(h)) * (high - low))
            row += [q, n or None]
        rows.append(row)
    schema = (f"`{by}` {df.schema[by].dataType.simpleString()}, " if by else "") + ", ".join(f"`q:{n}` array<double>, `n:{n}` long" for n in names)
    return spark.createDataFrame(rows, schema)
