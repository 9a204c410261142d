"""Operators as stages of a pipeline: each takes documents and returns documents, with what it decided done.

Rows are told apart by doc_id and the hash of their text, so that a table may repeat rows or ids. All columns of the documents are
passed on as they are, but for a text that is cut and its n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import bpe, quality
from ebbtide.llm.common import column, matches, table, without
from ebbtide.llm.decontaminate import decontaminate
from ebbtide.llm.lines import dedup_lines
from ebbtide.llm.near import near_duplicates
from ebbtide.runtime import materialize

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
ROW = ["doc_id", "_print"]
REMOVED = "_n_lines_removed_here"


def row_of(docs: DataFrame) -> dict[str, Column]:
    return {"doc_id": column(docs, "doc_id"), "_print": F.xxhash64(column(docs, "text"))}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject. Rows of one id and text but two languages go if either is rejected."""
    rejected = materialize(quality.assess(docs).where("NOT kept").select(*ROW).distinct())
    return without(docs, rejected, row_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks cut from later documents; a document of which nothing but white space is left goes, one that lost nothing stays."""
    left = F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = dedup_lines(docs, removed=REMOVED).where((F.col(REMOVED) == 0) | left)
    n_chars = F.when(F.col(REMOVED) > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cut.select(*((n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else column(cut, c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (of equal ids, the smallest hash), once."""
    found = materialize(near_duplicates(docs).select(*ROW, "_group").where("_group IS NOT NULL"))
    chosen = found.groupBy("_group").agg(F.min(F.struct(*ROW)).alias("_chosen"))
    other = found.join(chosen, "_group").where(F.struct(*ROW) != F.col("_chosen"))
    left = without(docs, materialize(other.select(*ROW).distinct()), row_of(docs))
    # Repeated rows of a chosen document: only they are brought together.
    again = materialize(found.groupBy(*ROW).agg(F.count("*").alias("_n")).where("_n > 1").select(*ROW))
    if not again.limit(1).count():
        return left
    repeated = left.join(again, matches(left, again, row_of(left)), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, again, row_of(left)).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, materialize(hit.where("contaminated").select(*ROW).distinct()), row_of(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of what they decode to, token_ids; a null text has no tokens, repeated rows stay."""
    return bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
