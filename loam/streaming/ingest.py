"""Continuous indexing: files that arrive in a folder are indexed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.embed import Embedder
from ..plans.ingest import index, sync
from ..sources.corpus import relative
from ..sources.store import Store


def arrivals(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """A stream of (source_file, text, arrived), one markdown file below the folder a row, named as the batch reader does."""
    d = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))
    return d.select(F.concat(F.lit(f"{prefix}/docs/"), relative(folder)).alias("source_file"), "text", "arrived")


def upsert(store: Store, settings: Settings, embedder: Embedder, stream: str = "arrivals"):
    """A function for foreachBatch. A batch's number is stored under the stream's name by the very manifest that shows what
    it did: one that comes again after that is left out, one that failed before it has left no trace and is done anew."""

    def run(batch: DataFrame, number: int) -> None:
        if store.has_batch(stream, number):
            return
        # of a file's versions in one batch the last one written, of equals (or where that isn't told) the greatest text
        if "arrived" not in batch.columns:
            batch = batch.withColumn("arrived", F.lit(None).cast("timestamp"))
        latest = batch.groupBy("source_file").agg(F.max(F.struct("arrived", "text"))["text"].alias("text"))
        none = batch.sparkSession.createDataFrame([], "source_file string")
        sync(store, index(latest, settings, store=store), none, embedder, (stream, number))

    return run


def start(spark: SparkSession, folder: str, store: Store, settings: Settings, embedder: Embedder, checkpoint: str, stream: str | None = None) -> StreamingQuery:
    """Index all files that are there and stop. stream: the name under which the store keeps its batches; the checkpoint's
    path if none, for that is what numbers them."""
    arrived = arrivals(spark, folder, settings.repo_prefix)
    return arrived.writeStream.foreachBatch(upsert(store, settings, embedder, stream or checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
