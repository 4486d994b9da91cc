"""Problem 6: the most similar mentions of every mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.permutation import nearest_above, nearest_of_queries
from glossweave.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine at least 0.95 of which one is among the other's 5 most similar."""
    near = nearest_above(table(spark, sf_dir, "mention_frame"), "mention_id", "embed", k=5, min_cosine=0.95)
    return near.select(F.least("id", "other").alias("mention_id_a"), F.greatest("id", "other").alias("mention_id_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar mentions of every mention whose id is divisible by 20, among all mentions."""
    near = nearest_of_queries(table(spark, sf_dir, "mention_frame"), "mention_id", "embed", "id % 20 = 0", k=5)
    return near.select(F.col("id").alias("mention_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"))


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
SQL: dict[str, str] = {}
