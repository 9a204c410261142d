"""Registry of queries and their oracle SQL, and the shared fixture tables on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, path) -> DataFrame under ``name`` with its oracle SQL."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def history(spark, path):
    return adapters.order_history(spark, path)


def customers(spark, path):
    return adapters.order_customers(spark, path)


def cohort(spark, path, dates=adapters.REF_DATES):
    return adapters.order_cohort(spark, path, dates)


_DATES = ", ".join(f"('{d}')" for d in adapters.REF_DATES)

HISTORY_SQL = """
o AS (
  SELECT o_custkey AS cust_id, last_day(CAST(o_orderdate AS DATE)) AS date,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_eft,
         floor(o_totalprice) AS amt, o_orderkey
  FROM orders),
brands AS (
  SELECT o.cust_id, o.date, COUNT(DISTINCT p_brand) AS nbr
  FROM o JOIN lineitem ON l_orderkey = o.o_orderkey JOIN part ON p_partkey = l_partkey
  GROUP BY o.cust_id, o.date),
money AS (
  SELECT cust_id, date,
         CAST(SUM(is_eft) AS DOUBLE) AS mobile_eft_all_cnt,
         SUM(is_eft * amt) AS mobile_eft_all_amt,
         CAST(SUM(1 - is_eft) AS DOUBLE) AS cc_transaction_all_cnt,
         SUM((1 - is_eft) * amt) AS cc_transaction_all_amt
  FROM o GROUP BY cust_id, date),
h AS (
  SELECT money.*, CAST(COALESCE(brands.nbr, 0) AS DOUBLE) AS active_product_category_nbr
  FROM money LEFT JOIN brands ON brands.cust_id = money.cust_id AND brands.date = money.date)"""

CUSTOMERS_SQL = """
customers AS (
  SELECT c_custkey AS cust_id,
         CAST(18 + c_custkey % 60 AS INT) AS age,
         CAST((c_custkey * 7) % 240 AS INT) AS tenure,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         n_name AS province, 'n/a' AS religion, c_mktsegment AS work_type, r_name AS work_sector
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

COHORT_SQL = f"""
refs AS (SELECT CAST(d AS DATE) AS ref_date FROM (VALUES {_DATES}) AS t(d)),
cohort AS (
  SELECT o_custkey AS cust_id, refs.ref_date,
         CAST(CASE WHEN MAX(CASE WHEN CAST(o_orderdate AS DATE) > refs.ref_date THEN 1 ELSE 0 END) = 0
              THEN 1 ELSE 0 END AS INTEGER) AS churn
  FROM refs JOIN orders ON CAST(o_orderdate AS DATE) > refs.ref_date - INTERVAL 12 MONTH
       AND CAST(o_orderdate AS DATE) <= refs.ref_date + INTERVAL 6 MONTH
  GROUP BY o_custkey, refs.ref_date
  HAVING MAX(CASE WHEN CAST(o_orderdate AS DATE) <= refs.ref_date THEN 1 ELSE 0 END) = 1)"""

# Every history row a cohort row may see, with its distance terms spelled out.
JOINED_SQL = """
j AS (
  SELECT c.cust_id, c.ref_date, h.date, h.mobile_eft_all_cnt, h.mobile_eft_all_amt, h.cc_transaction_all_amt,
         h.cc_transaction_all_cnt, h.active_product_category_nbr,
         COALESCE(h.mobile_eft_all_amt, 0) + COALESCE(h.cc_transaction_all_amt, 0) AS total_amt,
         COALESCE(h.mobile_eft_all_cnt, 0) + COALESCE(h.cc_transaction_all_cnt, 0) AS total_cnt,
         date_trunc('month', h.date) AS month
  FROM cohort c JOIN h ON h.cust_id = c.cust_id AND h.date <= c.ref_date)"""

PANEL = f"WITH {HISTORY_SQL.strip()}"
BASE = f"WITH {HISTORY_SQL.strip()},{CUSTOMERS_SQL},{COHORT_SQL}"
PIT = f"{BASE},{JOINED_SQL}"


def within(start: int, stop: int = 0) -> str:
    """SQL of the window (ref - start, ref - stop]."""
    hi = f"ref_date - INTERVAL {stop} MONTH" if stop else "ref_date"
    return f"date > ref_date - INTERVAL {start} MONTH AND date <= {hi}"
