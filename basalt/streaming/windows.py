"""Event-time windows, the same for bounded tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and their value by window and type; with ``late``, a watermark bounds a stream's state."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def run_to_table(spark: SparkSession, source: str, schema, target: str, checkpoint: str, width: str = "1 day") -> DataFrame:
    """Stream all Parquet files of ``source`` now present through the windows into ``target``; exactly once by the checkpoint.

    Update mode writes a batch's changed windows; the latest row of a window holds its result.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    query = tumbling_counts(stream, width, "30 days").writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(target)
    newest = done.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return newest.select("window_start", "event_type", "r.n", "r.total")


def sliding_counts(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Events by overlapping windows of ``width``, one every ``slide``, and type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Each user's runs of events with less than ``gap`` between them: start, last event and number."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("last_event"), "n")


def followed_within(first: DataFrame, then: DataFrame, key: str, time: str, within: str, late: str | None = None) -> DataFrame:
    """Pairs of a row and a later row of its key at most ``within`` after it; with ``late`` both sides' state is bounded on streams."""
    a = first.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("t"), F.col("event_id").alias("first_id"))
    b = then.select(F.col(key).alias("k2"), F.col(time).cast("timestamp").alias("t2"), F.col("event_id").alias("then_id"))
    if late:
        a, b = a.withWatermark("t", late), b.withWatermark("t2", late)
    return a.join(b, F.expr(f"k = k2 AND t2 > t AND t2 <= t + INTERVAL {within}")).select("first_id", "then_id")


def run_once(df: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append all that a stream has now to Parquet, exactly once by the checkpoint."""
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return df.sparkSession.read.parquet(target)
