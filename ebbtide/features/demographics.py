"""Customer attributes: right-closed bins and label codes."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.safe import right_closed_bin

# Fixed values.
AGE_EDGES = (0, 25, 35, 45, 55, 65, 100)
AGE_LABELS = ("18-25", "26-35", "36-45", "46-55", "56-65", "65+")
TENURE_EDGES = (0, 12, 36, 60, 120, 400)
TENURE_LABELS = ("0-1y", "1-3y", "3-5y", "5-10y", "10y+")
CATEGORICAL = ("gender", "province", "religion", "work_type", "work_sector", "age_group", "tenure_group")


def with_groups(customers: DataFrame) -> DataFrame:
    """Add age and tenure groups; a missing category is the text ``nan``, as is a value outside every bin."""
    out = customers.withColumn("age_group", right_closed_bin(F.col("age"), AGE_EDGES, AGE_LABELS)).withColumn(
        "tenure_group", right_closed_bin(F.col("tenure"), TENURE_EDGES, TENURE_LABELS)
    )
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in CATEGORICAL})


def fit_codes(customers: DataFrame) -> StringIndexerModel:
    """Codes in sorted label order. Fit on training customers, reuse for scoring."""
    return StringIndexer(
        inputCols=list(CATEGORICAL),
        outputCols=[f"{c}_encoded" for c in CATEGORICAL],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(with_groups(customers))


def demographics(customers: DataFrame, codes: StringIndexerModel | None = None) -> DataFrame:
    """``cust_id``, age, tenure and the codes. A category unseen in training gets the code after the last."""
    model = codes or fit_codes(customers)
    coded = model.transform(with_groups(customers))
    return coded.select(
        "cust_id", "age", "tenure", *[F.col(f"{c}_encoded").cast("int").alias(f"{c}_encoded") for c in CATEGORICAL]
    )
