"""Problem 9: personal information in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.pii import mask_pii, pii_spans
from glossweave.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence with its type and position."""
    return pii_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return mask_pii(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents by type."""
    return p9_found(spark, sf_dir).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_masked": p9_masked, "p9_types": p9_types}
SQL: dict[str, str] = {}
