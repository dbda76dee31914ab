"""Incident tables: explicit schema, file readers and the event-feed adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from roadwatch import settings as S

INCIDENT_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("id", T.StringType()), ("event_type", T.StringType()), ("event_cause", T.StringType()),
        ("corridor", T.StringType()), ("zone", T.StringType()), ("junction", T.StringType()),
        ("police_station", T.StringType()), ("priority", T.StringType()),
        ("requires_road_closure", T.StringType()), ("status", T.StringType()),
        ("start_datetime", T.StringType()), ("closed_datetime", T.StringType()),
        ("resolved_datetime", T.StringType()), ("veh_type", T.StringType()),
        ("latitude", T.DoubleType()), ("longitude", T.DoubleType()),
        ("endlatitude", T.DoubleType()), ("endlongitude", T.DoubleType()),
        ("assigned_to_police_id", T.StringType()), ("route_path", T.StringType()),
    ]
])

FEED_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# Column definitions over the raw feed (e = event id, u = user, k = payload key).
FEED_COLUMNS = {
    "id": "e",
    "event_type": "CASE WHEN k % 17 = 0 THEN 'planned' ELSE 'unplanned' END",
    "event_cause": (
        "CASE et WHEN 'click' THEN 'Vehicle_Breakdown ' WHEN 'view' THEN 'accident' "
        "WHEN 'signup' THEN 'pot_holes' WHEN 'purchase' THEN 'water_logging' "
        "ELSE CASE u % 3 WHEN 0 THEN 'public_event' WHEN 1 THEN 'vip_movement' ELSE 'construction' END END"
    ),
    "corridor": (
        "CASE WHEN u % 24 = 23 THEN NULL WHEN u % 24 < 3 THEN 'Non-corridor' "
        "ELSE concat('Road ', cast(u % 24 AS string)) END"
    ),
    "zone": "CASE WHEN k % 10 < 4 THEN concat('zone_', cast(u % 5 AS string)) END",
    "junction": "CASE WHEN k % 10 < 3 THEN concat('junction_', cast(k % 7 AS string)) END",
    "police_station": "concat('ps_', cast(u % 12 AS string))",
    "veh_type": "CASE WHEN et = 'click' THEN concat('veh_', cast(k % 4 AS string)) END",
    "priority": "CASE WHEN u % 24 < 14 OR (u % 24 = 15 AND k % 2 = 0) THEN 'High' ELSE 'Low' END",
    "requires_road_closure": "k % 12 = 0",
    "status": "CASE WHEN k % 8 = 7 THEN 'active' ELSE 'closed' END",
    "latitude": "CASE WHEN k = 99 THEN 0.0D ELSE 12.82D + ((u * 37) % 43) * 0.01D + ((e * 7919) % 1000) * 0.00001D END",
    "longitude": "CASE WHEN k = 99 THEN 0.0D ELSE 77.33D + ((u * 53) % 41) * 0.01D + ((e * 6271) % 1000) * 0.00001D END",
    "endlatitude": "CASE WHEN k % 12 = 0 THEN 12.822D + ((u * 37) % 43) * 0.01D WHEN k % 2 = 0 THEN 0.0D END",
    "endlongitude": "CASE WHEN k % 12 = 0 THEN 77.332D + ((u * 53) % 41) * 0.01D WHEN k % 2 = 0 THEN 0.0D END",
    "assigned_to_police_id": "CASE WHEN k = 50 THEN concat('P', cast(u AS string)) END",
    "route_path": (
        "CASE k WHEN 51 THEN '[[12.9,77.5],[12.91,77.51]]' WHEN 52 THEN '[]' "
        "WHEN 53 THEN '[[12.9,77.5],[12.91' END"
    ),
}
_LATER = "timestamp_micros(unix_micros(start_datetime) + cast(floor(value * 360000000) AS bigint))"


def incidents_from_feed(events: DataFrame) -> DataFrame:
    """Shape an event feed into the incident table (narrow projection, no shuffle)."""
    base = events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("et"),
        "value", F.col("ts").cast("timestamp").alias("start_datetime"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return base.select(
        *[F.expr(sql).alias(name) for name, sql in FEED_COLUMNS.items()],
        "start_datetime",
        F.expr(f"CASE WHEN k % 3 = 0 THEN {_LATER} END").alias("closed_datetime"),
        F.expr(f"CASE WHEN k % 6 = 1 THEN {_LATER} END").alias("resolved_datetime"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.schema(FEED_SCHEMA).parquet(path), "event_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Put a table of very few partitions on all cores.

    A file with one row group is read by one task. Only then, when the scan would use less
    than a quarter of the cores, the rows are spread by key; a table of many files
    is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 4 <= cores else df


def scan_incidents(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read an incident file with an explicit schema (CSV is never inferred)."""
    if fmt == "csv":
        return spark.read.schema(schema or INCIDENT_SCHEMA).option("header", True).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def missing_columns(df: DataFrame, required=S.REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def conform(df: DataFrame, mapping: dict[str, str] | None = None, schema: T.StructType = INCIDENT_SCHEMA) -> DataFrame:
    """Rename source columns to the incident names; absent ones become typed nulls."""
    mapping = mapping or {}
    return df.select(*[
        F.col(mapping.get(f.name, f.name)).alias(f.name) if mapping.get(f.name, f.name) in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
