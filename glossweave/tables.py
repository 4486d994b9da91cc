"""Access to input tables, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here, to = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/{here.name}", "zip", here.parent, here.name))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    A small table comes as fewer files than there are cores; only then are its rows moved, by ``key``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach.

    Only where the session names none (tests, a single machine) a local folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "glossweave-checkpoints")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy outlives executors, so later stages restart from it and not from the inputs.
    It is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, label: str = "t", condition: str = "true") -> tuple[DataFrame, int]:
    """``materialise`` and the number of rows for which ``condition`` holds, counted while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), label)
    return out, seen.get["n"]


def numbered_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The frame with ``name``, each row's place in ``order`` from 0.

    Rows are sorted in ranges, the ranges are counted, and each range is numbered on from the rows before it, so
    no task holds all rows. The driver sees one count for each range.
    """
    from pyspark.sql.window import Window

    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts, start, starts = sorted(ranged.groupBy("__range").count().collect()), 0, []
    for r in counts:
        starts.append((r["__range"], start))
        start += r["count"]
    first = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(first), "__range")
    return placed.withColumn(name, F.col("__start") + F.col("__inside")).drop("__range", "__start", "__inside")


def drop_materialised(df: DataFrame) -> None:
    """Remove a table of ``materialise`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
