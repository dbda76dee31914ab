"""Replay of an incident feed with Structured Streaming.

File sinks with a checkpoint give each row once, also after lost executors or a
restart. Event time carries the order, so the replay needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roadwatch.operators.anomaly import predicted_vs_actual
from roadwatch.sources.incidents import FEED_SCHEMA, incidents_from_feed


def publish_feed(events: DataFrame, path: str, mode: str = "append") -> None:
    """Lay a feed out by day, the layout a replay reads. Rows of a hot day stay spread over tasks."""
    events.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path)


def close_feed(spark: SparkSession, path: str, hours: int = 3) -> None:
    """End a finished feed with a marker ``hours`` after its last event, which moves the watermark past every open hour.

    The marker's own hour stays open, so it is never part of a result; ``hours`` must exceed the delay by two.
    """
    last = spark.read.schema(FEED_SCHEMA).parquet(path).agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL")
    columns = [f.strip().split() for f in FEED_SCHEMA.split(",")]
    marker = last.select(*[
        (F.col("ts") + F.expr(f"INTERVAL {hours} HOURS") if name == "ts" else F.lit(None)).cast(kind).alias(name) for name, kind in columns])
    publish_feed(marker, path)


def replay_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Incidents as a stream of files; ``files_per_trigger`` paces the replay."""
    reader = spark.readStream.schema(FEED_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return incidents_from_feed(reader.parquet(path))


def hourly_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts per corridor and clock hour; an hour is final once the watermark has passed it."""
    corridor = F.coalesce("corridor", F.lit("Non-corridor")).alias("corridor")
    return (
        stream.withWatermark("start_datetime", delay)
        .groupBy(F.window("start_datetime", "1 hour"), corridor).agg(F.count("*").alias("event_count"))
        .select(F.col("window.start").alias("hour_start"), "corridor", F.hour("window.start").alias("hour"), "event_count")
    )


def spikes(counts: DataFrame, lo: float, hi: float) -> DataFrame:
    """Counts outside the fitted baseline range; lo and hi are the two numbers of the model."""
    return counts.withColumn("is_anomaly", ~F.col("event_count").between(lo, hi)).filter("is_anomaly")


def accuracy_log(stream: DataFrame) -> DataFrame:
    """Prediction beside outcome for every event; actual durations are unknown in the replay."""
    return predicted_vs_actual(stream).withColumn("actual_duration", F.lit(None).cast("double"))


CLOSING_SCHEMA = "id bigint, closed_at timestamp, day date"


def publish_closings(incidents: DataFrame, path: str, mode: str = "append") -> None:
    """The closings of incidents as a feed of their own, laid out by the day of the closing."""
    ends = incidents.filter("closed_datetime IS NOT NULL").select("id", F.col("closed_datetime").cast("timestamp").alias("closed_at"))
    ends.withColumn("day", F.to_date("closed_at")).write.mode(mode).partitionBy("day").parquet(path)


def closing_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CLOSING_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).drop("day")


def close_outcomes(spark: SparkSession, feed: str, closings: str, wait_hours: int = 24) -> None:
    """End both feeds with a marker after every incident's waiting time, so that the log gets its last rows.

    Call it once nothing more comes. The marker among the closings has an id of its own; neither marker reaches the log.
    """
    close_feed(spark, feed, wait_hours + 3)
    limit = spark.read.schema(FEED_SCHEMA).parquet(feed).agg(F.max("ts").cast("timestamp").alias("closed_at"))
    last = spark.read.schema(CLOSING_SCHEMA).parquet(closings).agg(F.max("closed_at").alias("closed_at"))
    marker = limit.unionByName(last).agg(F.max("closed_at").alias("closed_at")).filter("closed_at IS NOT NULL")
    publish_closings(marker.select(F.lit(-1).cast("bigint").alias("id"), F.col("closed_at").alias("closed_datetime")), closings)


def outcome_log(stream: DataFrame, closings: DataFrame, wait_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Prediction beside outcome, with the actual duration in hours from a second stream of closings.

    An event waits ``wait_hours`` of event time for its closing; then it is logged without a duration and leaves the state,
    which so holds the events and closings of that span alone, dealt by id. A closing that comes after that, or that is
    earlier than its event, changes nothing. Of repeated closings the first to arrive counts, so a row is never doubled.
    """
    first = closings.withWatermark("closed_at", delay).dropDuplicatesWithinWatermark(["id"]).withColumnRenamed("id", "closing_id")
    waits = F.col("closed_at").between(F.col("start_datetime"), F.col("start_datetime") + F.expr(f"INTERVAL {wait_hours} HOURS"))
    both = stream.withWatermark("start_datetime", delay).join(first, (F.col("id") == F.col("closing_id")) & waits, "left_outer")
    hours = (F.unix_micros("closed_at") - F.unix_micros("start_datetime")) / 3.6e9
    return predicted_vs_actual(both, hours)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything there is into parquet and stop; a later call goes on where this one ended."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return query
