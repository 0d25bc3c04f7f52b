"""Block facts of an event stream, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.expr import amplitude_db, tidy
from gaugeworks.functions.shared import folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def block_facts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Count, extremes, mean and rms level of each type and window; works on a stream and on
    a table alike. What comes later than the watermark is dropped from a stream."""
    seen = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        seen = seen.withWatermark("_at", late)
    window = F.window("_at", length, slide) if slide else F.window("_at", length)
    facts = seen.groupBy(window.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), tidy(F.avg("value")).alias("mean"), tidy(amplitude_db(F.sqrt(F.avg(F.col("value") * F.col("value"))))).alias("rms_db")
    )
    return facts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "low", "high", "mean", "rms_db")


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    """A stream of the folder's files whose names match."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)


def run_to_end(stream: DataFrame, keys: list[str]) -> DataFrame:
    """What ``stream`` has made of all that is there now: a row per ``keys``. Each batch writes
    the rows that it changed to a folder of its own, so that a batch run again overwrites
    itself; of a key's rows the one of the last batch counts. Without input it is empty."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    put(spark.createDataFrame([], stream.schema), -1)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}") for c in rest])


def appended(stream: DataFrame) -> DataFrame:
    """What ``stream`` has given, once all that is there now has been read: rows that are final
    when they come are appended to files in the shared folder. Without input it is empty."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/none")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/none", *([f"{path}/rows"] if query.lastProgress else []))
