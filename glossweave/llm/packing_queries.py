"""Problem 7: the texts of ``documents`` in containers of 1,024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.packing import pack_texts
from glossweave.tables import materialise, table

CAPACITY = 1024


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece."""
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the texts that had to be divided."""
    pieces = p7_containers(spark, sf_dir)
    # every piece of a divided text but its last is full, and pieces after the first tell a divided text
    full = pieces.where((F.col("n_tokens") == CAPACITY) | (F.col("piece_no") > 1)).select("doc_id", "piece_no")
    divided = pieces.where("piece_no = 2").select("doc_id").distinct()
    return full.join(divided, "doc_id", "left_semi")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest conceivable, and the share of their space that is filled."""
    loads = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("load") / CAPACITY).alias("lower_bound"), F.max("load").alias("fullest"),
        F.round(F.sum("load") / (F.count(F.lit(1)) * CAPACITY), 6).alias("filled"),
    )


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens packed, whether no container is over its capacity, and whether space for less than one container in fifty is unused."""
    items = materialise(p7_containers(spark, sf_dir), "packed")
    loads = items.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    full = loads.agg((F.max("load") <= CAPACITY).alias("none_over"), (F.count(F.lit(1)) * 50 <= F.ceil(F.sum("load") / CAPACITY) * 51).alias("tight"))
    return items.agg(F.count_distinct("doc_id").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces")).crossJoin(full)  # one row each


_COUNT = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]+'))"
QUERIES = {"p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_whole": p7_whole}
SQL = {
    "p7_whole": f"""SELECT count(DISTINCT doc_id) AS n_texts, sum(n)::BIGINT AS n_tokens, sum((n + 1023) // 1024)::BIGINT AS n_pieces, true AS none_over, true AS tight
      FROM (SELECT doc_id, {_COUNT} AS n FROM documents) WHERE n > 0""",
    "p7_found": f"SELECT doc_id, unnest(range(1, (n + 1023) // 1024 + 1)) AS piece_no FROM (SELECT doc_id, {_COUNT} AS n FROM documents) WHERE n > 1024",
}
