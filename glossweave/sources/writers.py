"""Writers: mention tables, upserted artifacts, JSON documents, atomic checkpoints."""

from __future__ import annotations

import gzip
import json
import math
import os
import tempfile
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.frames import upsert
from glossweave.schema import conform


def write_mentions(df: DataFrame, path: str, mode: str = "append") -> None:
    """A mention frame as Parquet under the fixed schema; vectors may differ in length (K1)."""
    conform(df).write.mode(mode).parquet(path)


def write_any(df: DataFrame, path: str) -> None:
    """Parquet, CSV or JSON Lines by suffix; an existing target is refused."""
    kinds = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json"}
    kind = kinds.get(Path(path).suffix.lower())
    if kind is None:
        raise ValueError(f"unknown file type: {path}")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def merge_into(path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert ``new`` into the Parquet table at ``path`` and replace it whole (K2 to K4).

    The merged table is written beside the old one and renamed, so a lost executor or driver leaves
    either the old or the new table.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    merged = upsert(spark.read.parquet(path), new, keys) if fs.exists(target) else upsert(new.limit(0), new, keys)
    fresh, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    merged.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def plain(x):
    """A value as JSON can hold it: enums by name, NaN and infinities as null, other objects as text (K6, K7)."""
    if isinstance(x, Enum):
        return x.name
    if isinstance(x, dict):
        return {(k.name if isinstance(k, Enum) else str(k)): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


def json_rows(df: DataFrame) -> DataFrame:
    """One ``json`` column; NaN and infinities become null (K7, K8)."""
    cols = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def write_json(data: dict, path: str, schema: str | None = None) -> None:
    """A JSON document, gzip by suffix, sorted keys, through a temporary file."""
    body = json.dumps(plain(({"schema": schema} if schema else {}) | data), sort_keys=True, ensure_ascii=False)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as f:
        f.write(gzip.compress(body.encode()) if path.endswith(".gz") else body.encode())
    os.replace(temp, path)
