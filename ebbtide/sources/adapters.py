"""Reshape order and event tables into the churn input schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.periods import back

# The reference dates of the order panel; the last two form the scoring cohort.
REF_DATES = tuple(f"2000-{m:02d}-01" for m in range(1, 13))
TRAIN_DATES, SCORE_DATES = REF_DATES[:10], REF_DATES[10:]
URGENT = ("1-URGENT", "2-HIGH")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def order_history(spark: SparkSession, path: str) -> DataFrame:
    """Orders as a monthly panel: urgent orders play the first channel, the others the second.

    A month's row is dated at its end, so no row can hold orders placed after its date. Amounts are whole
    currency units. The product number is the number of brands bought in the month.
    """
    o = table(spark, path, "orders").select(
        F.col("o_custkey").alias("cust_id"),
        F.last_day("o_orderdate").alias("date"),
        F.col("o_orderpriority").isin(*URGENT).cast("double").alias("eft"),
        F.floor("o_totalprice").cast("double").alias("amt"),
        "o_orderkey",
    )
    brands = (
        table(spark, path, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(table(spark, path, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(o.select("cust_id", "date", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("cust_id", "date", "p_brand")
        .distinct()
        .groupBy("cust_id", "date")
        .agg(F.count(F.lit(1)).cast("double").alias("active_product_category_nbr"))
    )
    money = o.groupBy("cust_id", "date").agg(
        F.sum("eft").alias("mobile_eft_all_cnt"),
        F.sum(F.col("eft") * F.col("amt")).alias("mobile_eft_all_amt"),
        F.sum((1 - F.col("eft")) * F.col("amt")).alias("cc_transaction_all_amt"),
        F.sum(1 - F.col("eft")).alias("cc_transaction_all_cnt"),
    )
    return money.join(brands, ["cust_id", "date"], "left").fillna(0.0, ["active_product_category_nbr"])


def order_customers(spark: SparkSession, path: str) -> DataFrame:
    nation = table(spark, path, "nation").join(
        table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    return table(spark, path, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("cust_id"),
        (18 + key % 60).cast("int").alias("age"),
        ((key * 7) % 240).cast("int").alias("tenure"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("n_name").alias("province"),
        F.lit("n/a").alias("religion"),
        F.col("c_mktsegment").alias("work_type"),
        F.col("r_name").alias("work_sector"),
    )


def order_cohort(spark: SparkSession, path: str, dates: Sequence[str] = REF_DATES) -> DataFrame:
    """Customers with an order in the year before each date; churn = no order in the half year after it."""
    d = F.col("o_orderdate").cast("date")
    refs = F.array(*[F.lit(x).cast("date") for x in dates])
    near = F.filter(refs, lambda r: (d > back(r, 12)) & (d <= F.add_months(r, 6)))
    spread = table(spark, path, "orders").select(
        F.col("o_custkey").alias("cust_id"), d.alias("d"), F.explode(near).alias("ref_date")
    )
    grouped = spread.groupBy("cust_id", "ref_date").agg(
        F.max(F.when(F.col("d") > F.col("ref_date"), 1).otherwise(0)).alias("after"),
        F.max(F.when(F.col("d") <= F.col("ref_date"), 1).otherwise(0)).alias("before"),
    )
    return grouped.where("before = 1").select("cust_id", "ref_date", (1 - F.col("after")).alias("churn"))


def event_history(spark: SparkSession, path: str) -> DataFrame:
    """Events as a daily panel (windows are then counted in days). Amounts are whole units."""
    first = F.col("event_type").isin("purchase", "signup")
    second = F.col("event_type").isin("click", "view")
    value = F.floor(F.col("value")).cast("double")
    return (
        table(spark, path, "events")
        .groupBy(F.col("user_id").alias("cust_id"), F.to_date("ts").alias("date"))
        .agg(
            F.sum(first.cast("double")).alias("mobile_eft_all_cnt"),
            F.sum(F.when(first, value).otherwise(0.0)).alias("mobile_eft_all_amt"),
            F.sum(F.when(second, value).otherwise(0.0)).alias("cc_transaction_all_amt"),
            F.sum(second.cast("double")).alias("cc_transaction_all_cnt"),
            F.count_distinct("event_type").cast("double").alias("active_product_category_nbr"),
        )
    )
