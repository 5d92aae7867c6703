"""Continuous ingestion: a stream of records into a store of the latest one for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.operators.index import ChunkStore


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile():
        return reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())
    return reader.parquet(path)


def upsert_stream(stream: DataFrame, root: str, key: str, order: str, checkpoint: str) -> None:
    """Runs over what is there and stops: of every key the row with the greatest `order` ends in the store below `root`.

    Batches may come again after a failure; taking the latest row of old and new ones makes that harmless. A batch writes only the buckets of its keys.
    """
    store = ChunkStore(stream.sparkSession, root, key)

    def step(rows: DataFrame, _: int) -> None:
        store.merge(rows, [order])

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, events) by tumbling windows; rows later than the watermark are left out of a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), kind, "events")


def run_windowed_counts(spark: SparkSession, path: str, out: str, checkpoint: str, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours", files: int = 1) -> DataFrame:
    """(window_start, kind, events): runs `windowed_counts` as a stream over the files of a folder, `files` at a time, appending
    windows that the watermark has closed; the open ones at the end stay out, as do rows that came too late."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    counts = windowed_counts(reader.parquet(path), time, kind, window, late)
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
