"""Keeps chunk and posting tables up to date as Markdown files arrive, and counts events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..plans.build import chunk_table
from ..settings import Settings


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = Settings()):
    """Starts a query that adds each new file's chunks and postings to out/chunks and out/postings and stops when it has
    caught up. A batch is written under its number, so a batch that runs again replaces itself."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    docs = files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.make_valid_utf8(F.decode("content", "UTF-8")).alias("text"))

    def add(batch: DataFrame, number: int) -> None:
        chunk_table(batch, settings).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        chunks = batch.sparkSession.read.parquet(f"{out}/chunks/batch={number}")
        retrieval.postings(chunks).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and tumbling window, for batches and, with a watermark, streams."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
