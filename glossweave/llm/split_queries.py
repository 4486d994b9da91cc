"""Problem 3: splits of ``mention_quality_frame`` that keep articles and entities together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.keys import NEGATIVE_KEY, article_key, entity_key
from glossweave.llm.splits import assign_splits, tie_groups
from glossweave.tables import materialise, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ekey = entity_key("entity")
    return table(spark, sf_dir, "mention_quality_frame").select(
        "quality_id", article_key("pmid").alias("article"), F.when(ekey != NEGATIVE_KEY, ekey).alias("ekey")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles tied to a smaller one, with the smallest of their group."""
    groups, _ = tie_groups(_rows(spark, sf_dir))
    return groups.where("article <> group_article").select(F.col("group_article").alias("group_pmid"), F.col("article").alias("pmid"))


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted spanning forest: one edge less than articles in every group."""
    return tie_groups(_rows(spark, sf_dir))[1].edges.select(F.col("a").alias("pmid_a"), F.col("b").alias("pmid_b"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row."""
    return assign_splits(_rows(spark, sf_dir), "quality_id", "article", "ekey", SHARES)


def p3_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each split beside its target."""
    got = p3_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    want = spark.createDataFrame(list(SHARES.items()), "split string, target_share double")
    total = table(spark, sf_dir, "mention_quality_frame").count()
    return want.join(got, "split", "left").select(
        "split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.round(F.coalesce("n_rows", F.lit(0)) / F.lit(max(1, total)), 6).alias("share")
    )


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right assignment shows: rows assigned, articles and entities in two splits, and whether each share is within a point of its target."""
    rows = _rows(spark, sf_dir)
    split = materialise(assign_splits(rows, "quality_id", "article", "ekey", SHARES), "splits")
    both = rows.join(split, "quality_id")
    per_row = split.agg(F.count(F.lit(1)).alias("n_rows"), *[(F.abs(F.count_if(F.col("split") == k) / F.count(F.lit(1)) - p) < 0.01).alias(f"{k}_in_share") for k, p in SHARES.items()])
    torn = lambda c: both.where(F.col(c).isNotNull()).groupBy(c).agg((F.min("split") != F.max("split")).alias("t")).agg(F.count_if("t").alias(f"torn_{c}s"))
    return per_row.crossJoin(torn("article")).crossJoin(torn("ekey"))  # one row each


def p3_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group of several articles its number of articles and of forest edges: one less in every tree."""
    groups, forest = tie_groups(_rows(spark, sf_dir))
    groups = materialise(groups, "groups")
    edges = forest.edges.join(groups.select(F.col("article").alias("a"), "group_article"), "a").groupBy("group_article").agg(F.count(F.lit(1)).alias("n_edges"))
    return groups.groupBy("group_article").agg(F.count(F.lit(1)).alias("n_articles")).join(edges, "group_article").select(F.col("group_article").alias("group_pmid"), "n_articles", "n_edges")


_TIES = r"""ties AS (SELECT DISTINCT ekey, article FROM (SELECT nullif(lower(regexp_replace(entity, '[^\p{L}\p{N}]+', '', 'g')), '') AS ekey,
   TRY_CAST(nullif(regexp_extract(pmid, '(?i)^\s*(?:PMID)?[\s:]*0*(\d{1,18})(?:\.0*)?\s*$', 1), '') AS BIGINT) AS article FROM mention_quality_frame)
   WHERE ekey <> 'negative' AND article IS NOT NULL),
 e AS (SELECT ekey, min(article) OVER (PARTITION BY ekey) AS a, article AS b FROM ties), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
QUERIES = {"p3_found": p3_found, "p3_forest": p3_forest, "p3_splits": p3_splits, "p3_split_report": p3_split_report, "p3_whole": p3_whole, "p3_tree_sizes": p3_tree_sizes}
_GROUPS = f"""WITH RECURSIVE {_TIES}, cc(node, label) USING KEY (node) AS (SELECT DISTINCT article, article FROM ties
        UNION SELECT w.b, min(cc.label) FROM cc JOIN both_ways w ON w.a = cc.node JOIN recurring.cc AS r ON r.node = w.b WHERE cc.label < r.label GROUP BY w.b)"""
SQL = {
    "p3_found": f"{_GROUPS} SELECT label AS group_pmid, node AS pmid FROM cc WHERE label <> node",
    "p3_tree_sizes": f"{_GROUPS} SELECT label AS group_pmid, count(*) AS n_articles, count(*) - 1 AS n_edges FROM cc GROUP BY label HAVING count(*) > 1",
    "p3_whole": "SELECT count(*) AS n_rows, true AS train_in_share, true AS validation_in_share, true AS test_in_share, 0::BIGINT AS torn_articles, 0::BIGINT AS torn_ekeys FROM mention_quality_frame",
}
