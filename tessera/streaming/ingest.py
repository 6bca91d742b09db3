"""Resumable ingest of files as a stream: what is new is added, and a sample that comes again replaces its old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import source_hash


def hashed_samples(stream: DataFrame) -> DataFrame:
    return stream.select("sample_id", "label", source_hash(F.col("text")).alias("source_hash"), F.length("text").alias("n_chars"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "sample_id string, label int, text string, ts timestamp") -> StreamingQuery:
    """Takes all JSON files of source that no run took before, in one bounded run. Each micro-batch is written to a folder
    named by its number, so a batch that is repeated after a failure replaces itself and nothing is counted twice."""
    stream = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return hashed_samples(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The row of each sample's last batch."""
    d = spark.read.parquet(target)
    rows = d.groupBy("sample_id").agg(F.max(F.struct("batch", "label", "source_hash", "n_chars")).alias("x"))
    return rows.select("sample_id", "x.label", "x.source_hash", "x.n_chars")


def label_rates(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows and positives per window of event time; what is later than `late` is dropped with the window's state."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("label").alias("positives")).select("w.start", "n", "positives")
