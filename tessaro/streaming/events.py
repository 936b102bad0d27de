"""Streams of events: windowed counts with late data, exact duplicates dropped, latest state by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files; their schema is that of the files already there. ``path`` is a folder of files or one file."""
    there = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    alone = all(f.rstrip("/").endswith(f"/{name}") for f in there.inputFiles())
    source = spark.readStream.schema(there.schema)
    files = source.option("pathGlobFilter", name).parquet(folder) if alone else source.parquet(path)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Every event once: repeats that arrive within the watermark are dropped, and its state is kept no longer."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their values by type and window of time; rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is there and return the result as a table in the shared folder.

    Each micro-batch overwrites the table, so a batch that is run again after a failure changes
    nothing.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/result"
    schema = stream.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(out)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)
