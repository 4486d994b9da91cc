"""Canonical forms of entity and article identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVE = "__NEGATIVE__"
NEGATIVE_KEY = "negative"


def entity_key(c: Column | str) -> Column:
    """Letters and digits of an entity spelling in lower case; null when none are left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), F.lit(""))


def article_key(c: Column | str) -> Column:
    """The integer that a pmid spelling denotes, or null when it denotes none."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, r"(?i)^\s*(?:PMID)?[\s:]*0*(\d{1,18})(?:\.0*)?\s*$", 1)
    return F.nullif(digits, F.lit("")).cast("long")


def proper_entities(kb: DataFrame, kb_extension: DataFrame) -> DataFrame:
    """(ekey, entity): the proper form of every known entity key, the negative label included.

    One row per key: should two identifiers share a key, the knowledge base wins, then the
    smaller identifier.
    """
    spark = kb.sparkSession
    ids = (
        kb.select(F.lit(0).alias("ord"), F.col("entity_id"))
        .unionByName(kb_extension.select(F.lit(1).alias("ord"), F.col("entity_id")))
        .unionByName(spark.range(1).select(F.lit(-1).alias("ord"), F.lit(NEGATIVE).alias("entity_id")))
    )
    keyed = ids.select(entity_key("entity_id").alias("ekey"), F.struct("ord", "entity_id").alias("e"))
    return keyed.where("ekey IS NOT NULL").groupBy("ekey").agg(F.min("e").alias("e")).select("ekey", F.col("e.entity_id").alias("entity"))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null, as aggregates elsewhere skip them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
