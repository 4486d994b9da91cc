"""Problem 5: a tenth of the records of ``mention_quality_frame`` in the shares of ``sample_target``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.keys import entity_key
from glossweave.llm.quota import MAX_STRATA, draw_quotas, stratum_report
from glossweave.tables import materialise, table

KEYS = ["mention_id", "model", "layer", "sample_idx"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, as its first delivery has it; ``stratum`` numbers the strata of ``sample_target``, -1 for none."""
    strata = _targets(spark, sf_dir).select("ekey", "oov_label", "stratum_id")
    frame = table(spark, sf_dir, "mention_quality_frame").select(*KEYS, "quality_id", entity_key("entity").alias("ekey"), "oov_label")
    # a stratum's number stands for its two columns, so that the shuffle and its hash aggregation carry numbers only;
    # ``stratum_report`` refuses target tables past its bound, which is why this one may be broadcast
    named = frame.join(F.broadcast(strata), ["ekey", "oov_label"], "left").select(*KEYS, "quality_id", F.coalesce("stratum_id", F.lit(-1)).alias("stratum"))
    return named.groupBy(*KEYS).agg(F.min_by("stratum", "quality_id").alias("stratum"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_target").limit(MAX_STRATA + 1).withColumn("ekey", entity_key("entity"))


def _report(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    # records of no stratum are one row here, so there are no more rows than strata and one
    counts = records.groupBy("stratum").agg(F.count(F.lit(1)).alias("k")).collect()
    n = sum(r["k"] for r in counts) // 10
    targets = _targets(spark, sf_dir)
    counted = spark.createDataFrame([(r["stratum"], r["k"]) for r in counts], "stratum_id int, k long").join(F.broadcast(targets.select("stratum_id", "ekey", "oov_label")), "stratum_id")
    names = targets.select("stratum_id", F.col("ekey").alias("row"), F.col("oov_label").cast("string").alias("col"), "entity", "oov_label")
    return stratum_report(counted, targets, "ekey", "oov_label", n).join(F.broadcast(names), ["row", "col"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata to which slack arcs had to bring something; the check after it leaves those that lack records."""
    return _report(spark, sf_dir, _records(spark, sf_dir)).where("shortfall > 0 AND available < need").select("entity", "oov_label")


def p5_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, need, available rows, quota and shortfall of every stratum."""
    return _report(spark, sf_dir, _records(spark, sf_dir)).select("entity", "oov_label", "target", "need", "available", "quota", "shortfall")


def p5_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of ``p5_quotas`` that SQL can state: need, available rows and the least that any plan must give or lack."""
    return p5_quotas(spark, sf_dir).select(
        "entity", "oov_label", "target", "need", "available", (F.col("quota") + F.col("shortfall") >= F.col("need")).alias("accounted"), F.greatest(F.col("need") - F.col("available"), F.lit(0)).alias("lacking")
    )


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The report and the drawn records with ``stratum``."""
    records = materialise(_records(spark, sf_dir), "records")
    report = materialise(_report(spark, sf_dir, records), "strata")
    numbered = report.select(F.col("stratum_id").cast("string").alias("row"), F.lit("0").alias("col"), "quota")
    return report, draw_quotas(records.withColumn("one", F.lit("0")), numbered, "stratum", "one", KEYS)


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself, each record with its stratum."""
    report, drawn = _sample(spark, sf_dir)
    return drawn.join(F.broadcast(report.select(F.col("stratum_id").alias("stratum"), "entity", "oov_label")), "stratum").select(*KEYS, "entity", "oov_label")


def p5_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stratum whether the sample holds its quota, at most its records, and no record twice; and whether it is whole together."""
    report, drawn = _sample(spark, sf_dir)
    got = drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("k"), F.count_distinct(*KEYS).alias("d"))
    got = report.join(got, F.col("stratum") == F.col("stratum_id"), "left").fillna(0, ["k", "d"])
    return got.select(
        "entity", "oov_label", (F.col("k") == F.col("quota")).alias("as_planned"), (F.col("k") == F.col("d")).alias("no_repeat"),
        (F.col("k") >= F.least("need", "available")).alias("need_met_where_it_can"),
    )


_NEED = """WITH r AS (SELECT mention_id, model, layer, sample_idx, arg_min(lower(regexp_replace(entity, '[^\\p{L}\\p{N}]+', '', 'g')), quality_id) FILTER (quality_id = q) AS ekey,
    arg_min(oov_label, quality_id) FILTER (quality_id = q) AS oov_label
  FROM (SELECT *, min(quality_id) OVER (PARTITION BY mention_id, model, layer, sample_idx) AS q FROM mention_quality_frame) GROUP BY ALL),
 n AS (SELECT count(*) // 10 AS n FROM r), c AS (SELECT ekey, oov_label, count(*) AS k FROM r GROUP BY ALL)
 SELECT t.entity, t.oov_label, t.target_share, n, coalesce(k, 0) AS k, greatest(t.min_rows, floor(t.target_share::DECIMAL(9, 6) * n + 0.5)) AS need
 FROM sample_target t CROSS JOIN n LEFT JOIN c ON c.ekey = lower(regexp_replace(t.entity, '[^\\p{L}\\p{N}]+', '', 'g')) AND c.oov_label = t.oov_label"""

QUERIES = {"p5_found": p5_found, "p5_quotas": p5_quotas, "p5_needs": p5_needs, "p5_sample": p5_sample, "p5_drawn": p5_drawn}
SQL = {
    "p5_found": f"SELECT entity, oov_label FROM ({_NEED}) WHERE k < need",
    "p5_needs": f"""SELECT entity, oov_label, floor(target_share::DECIMAL(9, 6) * n + 0.5)::BIGINT AS target, need::BIGINT AS need, k AS available, true AS accounted,
        greatest(need - k, 0)::BIGINT AS lacking FROM ({_NEED})""",
    "p5_drawn": f"SELECT entity, oov_label, true AS as_planned, true AS no_repeat, true AS need_met_where_it_can FROM ({_NEED})",
}
