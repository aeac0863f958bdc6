"""Incremental embedding as a file stream: each micro-batch of new chunks adds only the vectors that miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.operators import embedding


def embed_new_chunks(spark: SparkSession, chunks_path: str, schema: str, vectors_path: str, checkpoint: str, embedder: embedding.Embedder, size: int = embedding.WINDOW) -> StreamingQuery:
    """Reads chunk files as they arrive and appends vectors to a Parquet table, each chunk_id once.

    A batch that is run again after a failure finds its vectors there and adds none. Windows are made of
    the batch's chunks of a document, so a document's chunks should arrive in one file.
    """
    vectors = "chunk_id string, v array<double>"

    def upsert(batch: DataFrame, _: int) -> None:
        try:
            cache = spark.read.schema(vectors).parquet(vectors_path)
        except Exception as e:  # the table is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], vectors)
        chunks = batch.dropDuplicates(["chunk_id"])
        plan = embedding.resume_plan(embedding.windows(chunks, size), cache)
        embedding.embed(plan, chunks, embedder).write.mode("append").parquet(vectors_path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(chunks_path)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream of events(ts, event_type, value) by tumbling windows."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
