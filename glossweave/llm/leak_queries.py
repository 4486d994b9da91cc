"""Problem 8: passages of ``eval_item`` in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.leaks import find_leaks
from glossweave.tables import table


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the words found and where."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak."""
    return p8_leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of leaking documents and the best overlap of every leaked item."""
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_documents"), F.round(F.max(F.col("matched_words") / F.col("n_words")), 6).alias("best_overlap")
    )


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
SQL: dict[str, str] = {}
