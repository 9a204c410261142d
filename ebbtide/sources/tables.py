"""Input tables with fixed schemas, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The input schemas.
SCHEMAS = {
    "customer_history": "cust_id bigint, date date, mobile_eft_all_cnt double, mobile_eft_all_amt double, "
    "cc_transaction_all_amt double, cc_transaction_all_cnt double, active_product_category_nbr double",
    "customers": "cust_id bigint, gender string, age int, province string, religion string, work_type string, "
    "work_sector string, tenure int",
    "reference_data": "cust_id bigint, ref_date date, churn int",
    "reference_data_test": "cust_id bigint, ref_date date",
}
PLACES = ("", "data/raw/", "data/")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def resolve(spark: SparkSession, root: str, name: str) -> str:
    """First of ``root``, ``root/data/raw`` and ``root/data`` that holds the table as CSV or Parquet."""
    tried = [f"{root}/{place}{name}.{kind}" for place in PLACES for kind in ("csv", "parquet")]
    for path in tried:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"{name}: looked in {', '.join(tried)}")


def _column_order(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the four input tables, typed without inference. CSV columns may come in any order."""
    path = resolve(spark, root, name)
    schema = T._parse_datatype_string(SCHEMAS[name])
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    kinds = {f.name: f.dataType for f in schema}
    order = _column_order(spark, path)
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in order])
    return spark.read.option("header", True).schema(full).csv(path).select(*[f.name for f in schema])


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """(cust_id, churn) as CSV or Parquet."""
    out = scores.select("cust_id", "churn").write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Feature matrix with keys and label, one folder per reference date, so a fold reads only its months."""
    matrix.repartition("ref_date", F.pmod(F.xxhash64("cust_id"), F.lit(64))).write.mode("overwrite").partitionBy(
        "ref_date"
    ).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
