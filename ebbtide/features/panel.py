"""The panel, the point-in-time join, and the one conditional aggregate all families share.

Shape of the work, for every family at once:

* history is merged to one row per customer and day (so no customer can hold more rows than the calendar has
  days), then moved once to its customer's partition;
* per-customer running columns are added there (previous row, place in the month, number of the month), which
  turns month-wise statistics into plain sums over rows;
* the cohort joins on ``cust_id`` with the rows of the last twelve periods and the latest row (which carries the
  whole-history statistics), and the result is grouped by (cust_id, ref_date) in the same partitions, without another
  shuffle. The fan-out does not grow with the length of the history. Each window is a condition in the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import periods

# The measure columns of the history table.
MEASURES = (
    "mobile_eft_all_cnt",
    "mobile_eft_all_amt",
    "cc_transaction_all_amt",
    "cc_transaction_all_cnt",
    "active_product_category_nbr",
)
EFT_CNT, EFT_AMT, CC_AMT, CC_CNT, PRODUCTS = MEASURES
DIFFED = (EFT_AMT, CC_AMT, PRODUCTS)

KEYS = ["cust_id", "ref_date"]

# Windows by tag as (from, to] in periods before the reference date; none reaches further back than the horizon.
SPANS = {
    "1": (0, 1), "3": (0, 3), "6": (0, 6), "12": (0, 12),
    "p1": (1, 2), "p3": (3, 6), "p6": (6, 12), "old": (6, 9),
}
BORDERS = (1, 2, 3, 6, 9, 12)
PEAK_BASE = 1 << 20
ROWS_PER_TASK = 1 << 16
"""Cohort and history rows that one task of the point-in-time join takes: its sorts and aggregates hold them at once."""


def tasks_for(*tables: DataFrame) -> int:
    """Tasks that keep ``ROWS_PER_TASK`` rows of the (written) tables each, and at least one a core."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def placed(df: DataFrame, tasks: int | None) -> DataFrame:
    """Rows placed by customer in a number of tasks that AQE does not merge; without a number left to Spark."""
    return df.repartition(tasks, "cust_id") if tasks else df


def merge_same_day(history: DataFrame) -> DataFrame:
    """One row per (cust_id, date): counts and amounts add up, the product number is the day's maximum.

    The table's key is (cust_id, date). Feeds that deliver several rows for a day are merged with map-side
    partial aggregation, so even a customer holding a third of all rows shrinks to one row per day before
    anything is gathered by customer.
    """
    aggs = [F.sum(c).alias(c) for c in MEASURES if c != PRODUCTS] + [F.max(PRODUCTS).alias(PRODUCTS)]
    return history.groupBy("cust_id", "date").agg(*aggs).select("cust_id", "date", *MEASURES)


def with_running_columns(panel: DataFrame) -> DataFrame:
    """Add what a row knows about its customer up to itself, and the next row (and next with the same product number).

    The ``run_`` columns hold whole-history statistics as of the row, so a reference date needs only the latest row
    before it for them, not the whole past.
    """
    w = Window.partitionBy("cust_id").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("cust_id", PRODUCTS).orderBy("date")
    amt = F.coalesce(EFT_AMT, F.lit(0.0)) + F.coalesce(CC_AMT, F.lit(0.0))
    cnt = F.coalesce(EFT_CNT, F.lit(0.0)) + F.coalesce(CC_CNT, F.lit(0.0))
    out = panel.withColumns(
        {"month_no": periods.month_number(F.col("date")), "total_amt": amt, "total_cnt": cnt}
    ).withColumns(
        {
            "prev_date": F.lag("date").over(w),
            "next_date": F.lead("date").over(w),
            "prev_month": F.lag("month_no").over(w),
            "row_no": F.row_number().over(w),
            **{f"diff_{c}": F.col(c) - F.lag(c).over(w) for c in DIFFED},
        }
    )
    fresh = F.col("prev_month").isNull() | (F.col("prev_month") != F.col("month_no"))
    out = out.withColumn("fresh", fresh).withColumns(
        {
            "month_row": F.col("row_no") - F.max(F.when(F.col("fresh"), F.col("row_no"))).over(upto) + 1,
            "month_ord": F.sum(F.col("fresh").cast("int")).over(upto) - 1,
        }
    )
    # Largest count first, earliest month on ties, in one long.
    out = out.withColumn(
        "peak_code", F.col("month_row") * F.lit(PEAK_BASE).cast("long") + (F.lit(PEAK_BASE) - F.col("month_no"))
    )
    running = {
        "run_first": F.min("date"),
        "run_eft": F.max(F.when(F.col(EFT_CNT) > 0, F.col("date"))),
        "run_cc": F.max(F.when(F.col(CC_CNT) > 0, F.col("date"))),
        "run_amt": F.sum("total_amt"),
        "run_cnt": F.sum("total_cnt"),
        "run_cnt_mean": F.avg("total_cnt"),
        "run_cnt_std": F.stddev_samp("total_cnt"),
        "run_squares": F.sum(2 * F.col("month_row") - 1),
        "run_peak": F.max("peak_code"),
        "run_xy": F.sum(F.col("month_ord") * F.col("total_amt")),
    }
    return out.withColumns({n: c.over(upto) for n, c in running.items()} | {"next_same": F.lead("date").over(same)})


def point_in_time(
    history: DataFrame, cohort: DataFrame, unit: str = "month", keyed: bool = False, horizon: int | None = 12,
    tasks: int | None = None,
) -> DataFrame:
    """Cohort rows with the history rows they need: those of the last ``horizon`` periods and the latest row.

    ``horizon=None`` joins every row on or before the reference date. ``keyed=True`` promises that (cust_id, date) is
    already unique and saves the merge. Cohort rows without history stay, with nulls on the history side.

    ``tasks`` (see :func:`tasks_for`) fixes how many tasks the rows are dealt to: what is shuffled is small, but it grows
    many times in the windows, the join and the aggregates behind, so partitions merged by their bytes are too large.
    """
    c = placed(cohort.select(*KEYS).distinct(), tasks)
    # Rows after the last reference date are not read (a runtime filter on the scan).
    panel = history.select("cust_id", "date", *MEASURES).where(F.col("date") <= c.agg(F.max("ref_date")).scalar())
    panel = panel if keyed else merge_same_day(panel)
    panel = with_running_columns(placed(panel, tasks).join(c.select("cust_id").distinct(), "cust_id", "left_semi"))
    latest = panel["next_date"].isNull() | (panel["next_date"] > c["ref_date"])
    on = (c["cust_id"] == panel["cust_id"]) & (panel["date"] <= c["ref_date"])
    if horizon is not None:
        on = on & ((panel["date"] > periods.back(c["ref_date"], horizon, unit)) | latest)
    joined = c.join(panel, on, "left").drop(panel["cust_id"])
    ref, date = F.col("ref_date"), F.col("date")
    band = F.when(date.isNull(), F.lit(None))
    for b in BORDERS:
        band = band.when(date > periods.back(ref, b, unit), F.lit(b))
    left = F.when(date.isNull(), F.lit(None))
    for b in (3, 6):
        left = left.when(date >= periods.back(ref, b, unit), F.lit(b))
    return joined.withColumns(
        {
            "band": band.otherwise(F.lit(999)),
            "left_band": left.otherwise(F.lit(999)),
            "start6": periods.back(ref, 6, unit),
            "month_gap": periods.month_number(ref) - F.col("month_no"),
            "is_latest": date.isNotNull() & (F.col("next_date").isNull() | (F.col("next_date") > ref)),
        }
    )


class Aggregates:
    """Collects the aggregates the requested families need; equal requests are made once."""

    def __init__(self) -> None:
        self.exprs: dict[str, Column] = {}

    def add(self, name: str, expr: Callable[[], Column]) -> Column:
        if name not in self.exprs:
            self.exprs[name] = expr()
        return F.col(name)

    @staticmethod
    def within(tag: str) -> Column:
        lo, hi = SPANS[tag]
        return (F.col("band") > lo) & (F.col("band") <= hi) if lo else F.col("band") <= hi

    def rows(self, tag: str) -> Column:
        """Row count, null (not 0) when the window is empty: an absent side makes a comparison null."""
        return F.nullif(self.add(f"_n_{tag}", lambda: F.count_if(self.within(tag))), F.lit(0))

    def sum(self, col: str, tag: str) -> Column:
        """Sum; 0 when the window has rows but no values, null when it has no rows."""
        s = self.add(f"_sum_{col}_{tag}", lambda: F.sum(F.when(self.within(tag), F.col(col))))
        return F.when(self.rows(tag).isNotNull(), F.coalesce(s, F.lit(0.0)))

    def latest(self, col: str) -> Column:
        """A column of the latest row on or before the reference date."""
        return self.add(f"_latest_{col}", lambda: F.max(F.when(F.col("is_latest"), F.col(col))))

    def _stat(self, fn, stat: str, col: str, tag: str) -> Column:
        return self.add(f"_{stat}_{col}_{tag}", lambda: fn(F.when(self.within(tag), F.col(col))))

    def mean(self, col: str, tag: str) -> Column:
        return self._stat(F.avg, "mean", col, tag)

    def std(self, col: str, tag: str) -> Column:
        return self._stat(F.stddev_samp, "std", col, tag)

    def min(self, col: str, tag: str) -> Column:
        return self._stat(F.min, "min", col, tag)

    def max(self, col: str, tag: str) -> Column:
        return self._stat(F.max, "max", col, tag)

    def active_months(self, tag: str) -> Column:
        """Distinct months with a row, as a bit per month distance (windows of at most 12 months)."""
        bit = F.call_function("shiftleft", F.lit(1), F.col("month_gap"))
        bits = self.add(f"_months_{tag}", lambda: F.bit_or(F.when(self.within(tag), bit)))
        return F.bit_count(bits).cast("long")


def month_from_number(no: Column) -> Column:
    zero = no - 1
    return F.make_date(F.floor(zero / 12).cast("int"), (zero % 12 + 1).cast("int"), F.lit(1))


def aggregate(joined: DataFrame, aggs: Aggregates) -> DataFrame:
    """One row per (cust_id, ref_date); the join already placed the rows, so this does not shuffle."""
    exprs = [e.alias(n) for n, e in aggs.exprs.items()] or [F.count("date").alias("_n_all")]
    return joined.groupBy(*KEYS).agg(*exprs)
