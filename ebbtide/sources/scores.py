"""Score files: per-model prediction files, submissions, the prediction bundle, importance tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names of the id and the score column.
ID_NAMES = ("cust_id", "id", "customer_id")
SCORE_NAMES = ("churn", "target", "score")


def read_model_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files named after their model, as (model, ...columns). One scan for the whole folder."""
    model = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.parquet", 1)
    return spark.read.parquet(f"{folder}/*.parquet").select(model.alias("model"), "*")


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob; a folder of part files is one path. Only the listing is read, not the files."""
    path = F.regexp_replace("path", "/part-[^/]*$", "").alias("path")
    found = spark.read.format("binaryFile").load(pattern).select(path).distinct().orderBy("path").collect()
    return [r.path for r in found]


def normalise_names(df: DataFrame) -> DataFrame:
    """``cust_id`` (as text) and ``churn`` whatever the file calls them; else the first other column scores."""
    lower = {c.lower().strip(): c for c in df.columns}
    key = next((lower[n] for n in ID_NAMES if n in lower), None)
    if key is None:
        raise ValueError(f"no id column among {df.columns}")
    others = [c for c in df.columns if c != key]
    score = next((lower[n] for n in SCORE_NAMES if n in lower), others[0] if others else None)
    if score is None:
        raise ValueError(f"no score column among {df.columns}")
    return df.select(
        F.col(f"`{key}`").cast("string").alias("cust_id"), F.col(f"`{score}`").try_cast("double").alias("churn")
    )


def read_submissions(spark: SparkSession, pattern: str, extra: Sequence[str] = ()) -> DataFrame:
    """All score files matching a glob as (model, cust_id, churn); files without the needed columns are skipped.

    The header of each file is read on its own, because files may name or order their columns differently.
    """
    parts = []
    for path in list_files(spark, pattern):
        raw = spark.read.option("header", True).csv(path)
        if len(raw.columns) < 2 or not {c.lower().strip() for c in raw.columns} & set(ID_NAMES):
            continue
        name = F.regexp_extract(F.lit(path), r"/submission_([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
        parts.append(normalise_names(raw).select(name.alias("model"), "cust_id", "churn"))
    if not parts:
        raise FileNotFoundError(f"no usable score file matches {pattern}")
    return reduce(DataFrame.unionByName, parts)


def align_to(ids: DataFrame, submissions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column per model for exactly the given ids, in a left join."""
    wide = submissions.groupBy("cust_id").pivot("model", list(models)).agg(F.first("churn"))
    return ids.select(F.col("cust_id").cast("string").alias("cust_id")).distinct().join(wide, "cust_id", "left")


def write_bundle(predictions: DataFrame, path: str) -> None:
    """Long predictions (split, model, cust_id, ref_date, y, p), one folder per split and model."""
    predictions.write.mode("overwrite").partitionBy("split", "model").parquet(path)


def read_bundle(
    spark: SparkSession, path: str, split: str | None = None, models: Sequence[str] | None = None
) -> DataFrame:
    """Predictions of the wanted split and models; the other folders are not listed into the scan."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if models is not None:
        df = df.where(F.col("model").isin(*models))
    return df


def attach_ids(scores: DataFrame, ids: DataFrame, keys: Sequence[str] = ("cust_id", "ref_date")) -> DataFrame:
    """Scores for every wanted id by key, never by row position; ids without a score stay with a null."""
    return ids.select(*keys).join(scores, list(keys), "left")


def read_importance(spark: SparkSession, pattern: str) -> DataFrame:
    """Importance tables as (source, model, feature, importance): the mean column, or the mean of the fold columns."""
    parts = []
    for path in list_files(spark, pattern):
        raw = spark.read.option("header", True).csv(path)
        folds = [c for c in raw.columns if c.startswith("importance_fold_")]
        if "feature" not in raw.columns:
            continue
        if "importance_mean" in raw.columns:
            value = F.col("importance_mean").cast("double")
        elif folds:
            value = reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in folds]) / len(folds)
        elif "importance" in raw.columns:
            value = F.col("importance").cast("double")
        else:
            continue
        source = F.regexp_extract(F.lit(path), r"/(feature_importance[^/]*?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
        model = F.regexp_replace(source, "^feature_importance_?", "")
        parts.append(raw.select(
            source.alias("source"), F.when(model == "", "all").otherwise(model).alias("model"),
            "feature", value.alias("importance"),
        ))
    if not parts:
        raise FileNotFoundError(f"no importance table matches {pattern}")
    return reduce(DataFrame.unionByName, parts)


def calibration_from_name(name):
    """Calibration method and gamma in a file name such as ``..._isotonic_g085.csv`` (three digits: hundredths,
    two: tenths)."""
    pattern = r"cal_ensemble_(isotonic|beta|none)_g(\d+)"
    method = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))
    gamma = F.when(F.length(digits) == 2, digits.cast("int") / F.lit(10.0)).otherwise(digits.cast("int") / F.lit(100.0))
    return method, gamma
