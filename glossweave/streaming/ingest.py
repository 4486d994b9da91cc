"""Streams of mentions: running entity totals, first deliveries, upserted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.functions.keys import entity_key
from glossweave.operators.frames import keep_last
from glossweave.sources.writers import merge_into


def read_stream(spark: SparkSession, pattern: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def entity_totals(stream: DataFrame) -> DataFrame:
    """Running row counts per entity (the streaming form of A2's counts)."""
    return stream.groupBy(entity_key("entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


def daily_totals(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Rows per entity and day of extraction; days close once the watermark passes, later rows are dropped."""
    timed = stream.withColumn("extracted_at", F.col("extracted_at").cast("timestamp")).where("extracted_at IS NOT NULL").withWatermark("extracted_at", lateness)
    return timed.groupBy(F.window("extracted_at", "1 day"), entity_key("entity").alias("entity")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "entity", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list) -> StreamingQuery:
    """Take in what is there and stop: every batch is upserted by key, the newest row wins (buffered ingest, K2)."""

    def batch(df: DataFrame, _: int) -> None:
        merge_into(path, keep_last(df, keys, order), keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_totals(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Final totals of what is there, through an in-memory sink (tests and small results)."""
    q = entity_totals(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
