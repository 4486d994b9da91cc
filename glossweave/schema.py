"""The mention frame: its schema, keys and provenance columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["pmid", "entity", "mention"]
PROVENANCE = ["a", "b", "a_abs", "b_abs", "itext", "ichunk"]
REQUIRED = [*KEYS, "embed"]

MENTION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in KEYS]
    + [T.StructField(c, T.LongType()) for c in PROVENANCE]
    + [T.StructField("embed", T.ArrayType(T.DoubleType()))]
)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def provenance_in(df: DataFrame) -> list[str]:
    """The provenance columns a frame has, in their order."""
    return [c for c in PROVENANCE if c in df.columns]


def conform(df: DataFrame) -> DataFrame:
    """The frame cast to the mention schema; absent provenance columns become null."""
    require(df, REQUIRED)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MENTION_SCHEMA])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes null, so that aggregates skip it (trap X1)."""
    cols = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(cols) if cols else df
