"""Problem 1: per-entity results where a few entities hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.keys import article_key, entity_key, proper_entities
from glossweave.operators.skew import key_profile
from glossweave.tables import table

METRICS = ("pca_residual", "pca_mahalanobis", "pca_spectral_entropy")


def entity_profile(spark: SparkSession, sf_dir: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Row count, number of articles, mean, mode and quantiles of the pca columns for every entity key."""
    frame = table(spark, sf_dir, "mention_quality_frame").select(entity_key("entity").alias("ekey"), article_key("pmid").alias("pmid"), *METRICS)
    return key_profile(frame, "ekey", {m: F.col(m) for m in METRICS}, {"articles": F.col("pmid")}, quantiles)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with at least 2 % of all rows, in proper form."""
    total = table(spark, sf_dir, "mention_quality_frame").count()
    large = entity_profile(spark, sf_dir, ()).where(F.col("ekey").isNotNull() & (F.col("n_rows") * 50 >= F.lit(total)))
    names = proper_entities(table(spark, sf_dir, "kb"), table(spark, sf_dir, "kb_extension"))
    # at most 50 keys can hold a fiftieth of the rows each
    return names.join(F.broadcast(large.select("ekey")), "ekey").select("entity")


def p1_entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile, rounded, for every entity of the frame in proper form."""
    names = proper_entities(table(spark, sf_dir, "kb"), table(spark, sf_dir, "kb_extension"))
    prof = entity_profile(spark, sf_dir).where("ekey IS NOT NULL").join(names, "ekey")
    cols = [F.col("n_rows").cast("long"), F.col("n_articles").cast("long")]
    for m in METRICS:
        cols += [F.col(f"n_{m}").cast("long")] + [F.round(f"{a}_{m}", 9).alias(f"{a}_{m}") for a in ("mean", "mode", "q25", "q50", "q75")]
    return prof.select("entity", *cols)


_KEY = "nullif(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '')"
_NAMES = f"""names AS (
  SELECT ekey, arg_min(entity_id, (ord, entity_id)) AS entity FROM (
    SELECT {_KEY.format('entity_id')} AS ekey, entity_id, ord FROM (
      SELECT entity_id, 0 AS ord FROM kb UNION ALL SELECT entity_id, 1 FROM kb_extension UNION ALL SELECT '__NEGATIVE__', -1)) GROUP BY ekey)"""

_STATS = ", ".join(
    f"count(CASE WHEN NOT isnan({m}) THEN {m} END) AS n_{m}, round(avg(CASE WHEN NOT isnan({m}) THEN {m} END), 9) AS mean_{m}, "
    + ", ".join(f"round(quantile_cont(CASE WHEN NOT isnan({m}) THEN {m} END, {q / 100}), 9) AS q{q}_{m}" for q in (25, 50, 75))
    for m in METRICS
)
_MODES = " ".join(
    f"LEFT JOIN (SELECT ekey, round(v, 9) AS mode_{m} FROM (SELECT ekey, {m} AS v, row_number() OVER (PARTITION BY ekey ORDER BY count(*) DESC, {m}) AS r "
    f"FROM f WHERE NOT isnan({m}) GROUP BY ekey, {m}) WHERE r = 1) USING (ekey)"
    for m in METRICS
)

QUERIES = {"p1_found": p1_found, "p1_entity_profile": p1_entity_profile}
SQL = {
    "p1_found": f"""WITH {_NAMES}, f AS (SELECT {_KEY.format('entity')} AS ekey FROM mention_quality_frame)
        SELECT entity FROM names JOIN (SELECT ekey FROM f WHERE ekey IS NOT NULL GROUP BY ekey HAVING count(*) * 50 >= (SELECT count(*) FROM f)) USING (ekey)""",
    "p1_entity_profile": f"""WITH {_NAMES}, f AS (SELECT {_KEY.format('entity')} AS ekey,
          TRY_CAST(nullif(regexp_extract(pmid, '(?i)^\\s*(?:PMID)?[\\s:]*0*(\\d{{1,18}})(?:\\.0*)?\\s*$', 1), '') AS BIGINT) AS article, * FROM mention_quality_frame),
        g AS (SELECT ekey, count(*) AS n_rows, count(DISTINCT article) AS n_articles, {_STATS} FROM f WHERE ekey IS NOT NULL GROUP BY ekey)
        SELECT * EXCLUDE (ekey) FROM names JOIN g USING (ekey) {_MODES}""",
}
