"""What the operators share: names that cannot clash, word patterns, small broadcasts of measured size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BROADCAST_BYTES = 32 << 20
"""Largest table that is broadcast, measured before it is; larger ones are worked off in blocks of this size."""

ARROW_ROWS = 256
"""Rows per Arrow batch: texts may be very long, and a Python worker holds a few batches at once."""


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python need not find it on its own path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ebbtide-")), "ebbtide.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "ebbtide").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """For an operator that runs Python: small Arrow batches, as a batch of long texts must fit a worker, and this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def blocks(keyed: DataFrame, key: str, row_bytes: int) -> list[DataFrame]:
    """``keyed`` (a written table) cut by ``key`` into parts small enough to broadcast; most often one part.

    The rows are counted, never assumed; rows of one key share a block.
    """
    n = max(1, -(-keyed.count() * row_bytes // BROADCAST_BYTES))
    if n == 1:
        return [F.broadcast(keyed)]
    return [F.broadcast(keyed.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)) for b in range(n)]


def column(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by reference: right even where a joined table has one of the same name."""
    return df[f"`{name}`"]


def matches(docs: DataFrame, rows: DataFrame, on: dict[str, Column]) -> Column:
    """Equality, null to null, of columns of ``rows`` with expressions over ``docs``."""
    return reduce(lambda a, b: a & b, [expr.eqNullSafe(column(rows, name)) for name, expr in on.items()])


def without(docs: DataFrame, gone: DataFrame, on: dict[str, Column], row_bytes: int = 64) -> DataFrame:
    """The rows of ``docs`` that match no row of ``gone``, a written table.

    A small table is broadcast, after its rows have been counted, so that texts stay where they are; a larger one is joined.
    """
    small = gone.count() * row_bytes <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, matches(docs, gone, on), "left_anti")
