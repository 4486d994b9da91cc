"""The tables in canonical form, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.keys import NEGATIVE_KEY, article_key, entity_key, finite
from glossweave.functions.vectors import is_usable
from glossweave.schema import PROVENANCE
from glossweave.tables import table

NEG = NEGATIVE_KEY
METRICS = ("pca_residual", "pca_mahalanobis", "pca_spectral_entropy")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mention frame with canonical keys; all rows."""
    return table(spark, d, "mention_frame").select(
        F.col("mention_id").alias("row_id"), article_key("pmid").alias("pmid"), entity_key("entity").alias("entity"), "mention", *PROVENANCE, "embed"
    )


def usable_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with a usable vector."""
    return mentions(spark, d).where(is_usable("embed", 64))


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality frame with canonical keys, NaN as null."""
    return table(spark, d, "mention_quality_frame").select(
        F.col("quality_id").alias("row_id"), "mention_id", "model", "layer", "sample_idx", entity_key("entity").alias("entity"), article_key("pmid").alias("pmid"),
        "mention", "cluster", "oov_label", *[finite(m).alias(m) for m in METRICS],
    )


def knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    """Both knowledge bases with an order: kb first, each by identifier."""
    kb = table(spark, d, "kb").withColumn("src", F.lit(0)).unionByName(table(spark, d, "kb_extension").withColumn("src", F.lit(1)))
    return kb.withColumn("ord", F.concat(F.col("src").cast("string"), F.lit(":"), "entity_id"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Grid export as loaded."""
    return table(spark, d, "grid_export")


EKEY = "nullif(lower(regexp_replace(entity, '[^\\p{L}\\p{N}]+', '', 'g')), '')"
ARTICLE = "TRY_CAST(nullif(regexp_extract(pmid, '(?i)^\\s*(?:PMID)?[\\s:]*0*(\\d{1,18})(?:\\.0*)?\\s*$', 1), '') AS BIGINT)"
M = f"m AS (SELECT mention_id AS row_id, {ARTICLE} AS pmid, {EKEY} AS entity, mention, a, b, a_abs, b_abs, itext, ichunk, embed FROM mention_frame)"
U = M + ", u AS (SELECT * FROM m WHERE len(embed) = 64 AND list_bool_and([isfinite(x) AND x IS NOT NULL for x in embed]) AND list_bool_or([x <> 0 for x in embed]))"
_FIN = ", ".join(f"CASE WHEN isfinite({m}) THEN {m} END AS {m}" for m in METRICS)
Q = f"q AS (SELECT quality_id AS row_id, mention_id, model, layer, sample_idx, {EKEY} AS entity, {ARTICLE} AS pmid, mention, cluster, oov_label, {_FIN} FROM mention_quality_frame)"
KB = "k AS (SELECT *, 0 AS src, '0:' || entity_id AS ord FROM kb UNION ALL SELECT *, 1, '1:' || entity_id FROM kb_extension)"


def draw_sql(row_id: str, seed: int) -> str:
    """``operators.frames.draw`` in SQL."""
    return f"(({row_id} * 7919 + {seed * 104729 + 17} * ({row_id} % 1009)) % 1000003)"
