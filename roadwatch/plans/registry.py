"""Registry of named queries with their comparison SQL, and shared SQL prefixes."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadwatch.operators import cleaning
from roadwatch.sources import incidents as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent over the raw tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def feed(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")   # every hour of the data model is a UTC hour
    return src.read_feed(spark, os.path.join(sf, "events.parquet"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    return src.incidents_from_feed(feed(spark, sf))


def spatial(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.spatial_view(incidents(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.feature_view(incidents(spark, sf))


_ARTEFACTS: dict[tuple, str] = {}


def artefact(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A published artefact: built once per session, kept in the shared folder."""
    from roadwatch.session import new_folder

    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _ARTEFACTS:
        path = new_folder(spark, name)
        build().write.parquet(path)
        _ARTEFACTS[key] = path
    return spark.read.parquet(_ARTEFACTS[key])


# ---------------------------------------------------------------- shared SQL
def _duck(sql: str) -> str:
    return (sql.replace("AS string", "AS varchar").replace("0.0D", "0.0::DOUBLE")
            .replace("12.82D", "12.82::DOUBLE").replace("77.33D", "77.33::DOUBLE")
            .replace("12.822D", "12.822::DOUBLE").replace("77.332D", "77.332::DOUBLE")
            .replace("0.01D", "0.01::DOUBLE").replace("0.00001D", "0.00001::DOUBLE"))


_LATER = "make_timestamp(epoch_us(start_datetime) + CAST(floor(value * 360000000) AS BIGINT))"

INCIDENTS_SQL = (
    "WITH feed AS (SELECT event_id AS e, user_id AS u, event_type AS et, value, ts AS start_datetime, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    "incidents AS (SELECT "
    + ", ".join(f"{_duck(sql)} AS {name}" for name, sql in src.FEED_COLUMNS.items())
    + f", start_datetime, CASE WHEN k % 3 = 0 THEN {_LATER} END AS closed_datetime, "
    f"CASE WHEN k % 6 = 1 THEN {_LATER} END AS resolved_datetime FROM feed)"
)


def _cat(c: str, default: str, extra: str = "") -> str:
    text = f"lower(trim({c}))"
    inner = f"nullif({text}, '')"
    if extra:
        inner = f"nullif({inner}, '{extra}')"
    return f"coalesce({inner}, '{default}')"


_SP = dict(
    hour="CAST(coalesce(hour(start_datetime), 12) AS INTEGER)",
    dow="CAST(coalesce(isodow(start_datetime) - 1, 0) AS INTEGER)",
    month="CAST(coalesce(month(start_datetime), 1) AS INTEGER)",
)

SPATIAL_SQL = INCIDENTS_SQL + f""", sp0 AS (
SELECT id, start_datetime AS start_ts, {_SP['hour']} AS hour, {_SP['dow']} AS dow, {_SP['month']} AS month,
 latitude AS lat, longitude AS lon, nullif(endlatitude, 0.0) AS end_lat, nullif(endlongitude, 0.0) AS end_lon,
 (nullif(endlatitude, 0.0) IS NOT NULL AND nullif(endlongitude, 0.0) IS NOT NULL) AS has_end_coord,
 {_cat('event_cause', 'unknown', 'null')} AS cause, {_cat('corridor', 'non-corridor', 'null')} AS corridor,
 {_cat('zone', 'no_zone', 'null')} AS zone, {_cat('junction', 'no_junction', 'null')} AS junction,
 {_cat('priority', 'unknown', 'null')} AS priority, {_cat('event_type', 'unplanned', 'null')} AS event_type,
 CAST(requires_road_closure AS INTEGER) AS closure,
 CASE WHEN lower(trim(priority)) = 'high' THEN 1 ELSE 0 END AS is_high_priority
FROM incidents WHERE latitude BETWEEN 12.80 AND 13.27 AND longitude BETWEEN 77.31 AND 77.77),
sp AS (SELECT *, CASE WHEN hour BETWEEN 4 AND 7 THEN 'early_morning' WHEN hour BETWEEN 19 AND 22 THEN 'evening'
 WHEN hour BETWEEN 0 AND 3 THEN 'late_night' ELSE 'off_peak' END AS time_band,
 CAST(least(greatest(round_even(1 + 9 * (0.4::DOUBLE * is_high_priority + 0.4::DOUBLE * closure
  + 0.2::DOUBLE * (CASE WHEN event_type = 'planned' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)), 0), 1), 10) AS INTEGER) AS impact_score
 FROM sp0)"""

FEATURES_SQL = INCIDENTS_SQL + f""", ft0 AS (
SELECT id, start_datetime AS start_ts, {_cat('event_cause', 'unknown')} AS cause_cat,
 {_cat('corridor', 'no_corridor')} AS corridor_cat, {_cat('zone', 'no_zone')} AS zone_cat,
 {_cat('veh_type', 'not_applicable')} AS veh_type_cat, {_cat('police_station', 'unknown')} AS police_station_cat,
 {_SP['hour']} AS hour, {_SP['dow']} AS dow, {_SP['month']} AS month,
 CASE WHEN lower(trim(event_type)) IN ('planned', 'scheduled') THEN 1 ELSE 0 END AS is_planned,
 latitude AS lat, longitude AS lon, CAST(requires_road_closure AS INTEGER) AS closure,
 CASE WHEN lower(trim(priority)) = 'high' THEN 1 ELSE 0 END AS high,
 (epoch_us(coalesce(closed_datetime, resolved_datetime)) - epoch_us(start_datetime)) / 3600000000.0::DOUBLE AS duration_h
FROM incidents),
ft AS (SELECT *, CASE WHEN dow >= 5 THEN 1 ELSE 0 END AS is_weekend,
 CASE WHEN hour BETWEEN 4 AND 7 THEN 1 ELSE 0 END AS is_morning_peak,
 CASE WHEN hour BETWEEN 19 AND 22 THEN 1 ELSE 0 END AS is_evening_peak,
 CASE WHEN hour BETWEEN 12 AND 16 THEN 1 ELSE 0 END AS is_midday_quiet FROM ft0)"""

# Portable 32-bit hash of an id, same as functions.columns.portable_hash.
def hash_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def on_incidents(sql: str) -> str:
    return INCIDENTS_SQL + " " + sql


def on_spatial(sql: str) -> str:
    return SPATIAL_SQL + " " + sql


def on_features(sql: str) -> str:
    return FEATURES_SQL + " " + sql
