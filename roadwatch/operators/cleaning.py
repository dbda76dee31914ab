"""Cleaned and enriched incident views (projections and filters only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.functions.geo import in_box


def bbox_filter(df: DataFrame, lat="latitude", lon="longitude") -> DataFrame:
    return df.filter(in_box(C.to_number(lat), C.to_number(lon)))


def with_time(df: DataFrame, start="start_datetime") -> DataFrame:
    ts = C.parse_timestamp(start)
    return df.withColumns({"start_ts": ts, "hour": C.hour_of(ts), "dow": C.weekday_of(ts), "month": C.month_of(ts)})


def with_peaks(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_weekend": C.flag(F.col("dow") >= 5),
        "is_morning_peak": C.flag(C.within("hour", 4, 7)),
        "is_evening_peak": C.flag(C.within("hour", 19, 22)),
        "is_midday_quiet": C.flag(C.within("hour", 12, 16)),
    })


def with_end_coords(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "end_lat": C.zero_to_null("endlatitude"), "end_lon": C.zero_to_null("endlongitude"),
    }).withColumn("has_end_coord", F.col("end_lat").isNotNull() & F.col("end_lon").isNotNull())


def spatial_view(df: DataFrame, in_box_only: bool = True) -> DataFrame:
    """The table behind every spatial and corridor operator.

    One narrow projection: bounding box, clean categories, labels, time band and
    the 1–10 proxy impact score.
    """
    df = bbox_filter(df) if in_box_only else df
    df = with_end_coords(with_time(df))
    priority = C.spatial_category("priority", "unknown")
    event_type = C.spatial_category("event_type", "unplanned")
    df = df.select(
        "id", "start_ts", "hour", "dow", "month",
        C.to_number("latitude").alias("lat"), C.to_number("longitude").alias("lon"),
        "end_lat", "end_lon", "has_end_coord",
        C.spatial_category("event_cause", "unknown").alias("cause"),
        C.spatial_category("corridor", "non-corridor").alias("corridor"),
        C.spatial_category("zone", "no_zone").alias("zone"),
        C.spatial_category("junction", "no_junction").alias("junction"),
        priority.alias("priority"), event_type.alias("event_type"),
        C.truth("requires_road_closure", S.TRUTH_SPATIAL).alias("closure"),
        (priority == "high").cast("int").alias("is_high_priority"),
        (event_type == "planned").cast("int").alias("planned"),
    )
    score = C.proxy_impact(F.col("is_high_priority"), F.col("closure"), F.col("planned"))
    return (
        df.withColumns({"time_band": C.time_band("hour"), "impact_score": score})
        .withColumn("impact_weight", F.col("impact_score") / 10.0)
        .drop("planned")
    )


def feature_view(df: DataFrame) -> DataFrame:
    """Model features and labels; end coordinates are left out on purpose."""
    has = set(df.columns)
    df = with_peaks(with_time(df))
    text = {
        "cause_cat": ("event_cause", "unknown"), "corridor_cat": ("corridor", "no_corridor"),
        "zone_cat": ("zone", "no_zone"), "veh_type_cat": ("veh_type", "not_applicable"),
        "police_station_cat": ("police_station", "unknown"),
    }
    return df.select(
        "id", "start_ts",
        *[(C.clean_category(src, d) if src in has else F.lit(d)).alias(name) for name, (src, d) in text.items()],
        "hour", "dow", "month", "is_weekend", "is_morning_peak", "is_evening_peak", "is_midday_quiet",
        C.is_planned("event_type", "event_cause", "event_type" in has).alias("is_planned"),
        F.coalesce(C.to_number("latitude"), F.lit(0.0)).alias("lat"),
        F.coalesce(C.to_number("longitude"), F.lit(0.0)).alias("lon"),
        C.truth("requires_road_closure", S.TRUTH_WIDE).alias("closure"),
        C.is_high("priority").alias("high"),
        C.duration_hours(F.col("start_ts"), C.parse_timestamp("closed_datetime"),
                         C.parse_timestamp("resolved_datetime")).alias("duration_h"),
    )


def normalize_requests(df: DataFrame) -> DataFrame:
    """Same defaults for a table of scoring requests (cause, corridor, …, start_datetime)."""
    ts = C.parse_timestamp("start_datetime")
    out = df.select(
        "*", C.clean_category("cause", "unknown").alias("cause_cat"),
        C.clean_category("corridor", "no_corridor").alias("corridor_cat"),
        C.clean_category("zone", "no_zone").alias("zone_cat"),
        C.clean_category("veh_type", "not_applicable").alias("veh_type_cat"),
        C.clean_category("police_station", "unknown").alias("police_station_cat"),
        C.hour_of(ts).alias("hour"), C.weekday_of(ts).alias("dow"), C.month_of(ts).alias("month"),
    )
    return with_peaks(out)


def fill_missing_features(df: DataFrame) -> DataFrame:
    """Add absent feature columns: 'unknown' for categories, 0 for numbers."""
    add = {c: F.lit("unknown") for c in S.CATEGORICAL_FEATURES if c not in df.columns}
    add |= {c: F.lit(0) for c in S.NUMERIC_FEATURES if c not in df.columns}
    return df.withColumns(add) if add else df


def usable_durations(features: DataFrame) -> DataFrame:
    return features.filter(C.usable_duration(F.col("duration_h")))
