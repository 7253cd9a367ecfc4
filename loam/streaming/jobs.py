"""Streams: ingest with duplicates dropped, windows of health, and the periodic cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.functions import text as T
from loam.operators import dedup, profile, retrieval


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drop_repeated(stream: DataFrame, time_col: str, content_col: str, delay: str = "1 hour") -> DataFrame:
    """Texts that came within the delay before, equal but for white space, are dropped; state older than the watermark goes."""
    return stream.withWatermark(time_col, delay).withColumn("hash", T.normalized_hash(F.col(content_col))).dropDuplicatesWithinWatermark(["hash"])


def windows(stream: DataFrame, time_col: str, value: Column, length: str = "1 day", slide: str | None = None, delay: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Counts and means per window; late rows up to the delay count."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return stream.withWatermark(time_col, delay).groupBy(window.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "mean")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def on_ingest(chunks: DataFrame, as_of: Column) -> DataFrame:
    """One batch of chunks: duplicates out, quality in, noise out."""
    kept = dedup.survivors(chunks)
    return retrieval.embed_quality(kept, as_of).where(~T.is_blank(F.col("content")))


def ingest(stream: DataFrame, store: str, checkpoint: str, as_of: Column | None = None, batch_profile: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each micro-batch of new chunks to the store; what the store already has is left out.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = on_ingest(batch, as_of if as_of is not None else F.localtimestamp()).withColumn("hash", T.normalized_hash(F.col("content")))
        try:
            seen = spark.read.parquet(store).where(F.col("batch") != number).select("hash")
            new = new.join(seen, "hash", "left_anti")
        except Exception as e:  # the first batch: no store yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        if batch_profile:
            batch_profile(profile.chunk_profile(batch), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def periodic(spark: SparkSession, tick: Callable[[int], None], interval: str = "1 hour", checkpoint: str | None = None) -> StreamingQuery:
    """Calls tick for each trigger: the run loop. stop() of the result ends it."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = beat.writeStream.foreachBatch(lambda _, number: tick(number)).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def status(query: StreamingQuery) -> dict:
    return {"running": query.isActive, "last": query.lastProgress}
