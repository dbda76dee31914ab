"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from roadwatch import settings as S


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    """Squared half chord of the unit sphere between two points; grows with their distance."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a = half_chord(lat1, lon1, lat2, lon2)
    return 2 * S.EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_m(lat1, lon1, lat2, lon2, radius: float, strict: bool = False) -> Column:
    """Is the distance within the radius? Compares chords, which spares a root and an arc tangent per pair."""
    limit = math.sin(radius / (2 * S.EARTH_RADIUS_M)) ** 2
    a = half_chord(lat1, lon1, lat2, lon2)
    return a < limit if strict else a <= limit


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first to the second point, 0 ≤ b < 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    turn = F.degrees(F.atan2(east, north)) + 360.0
    return F.when(turn >= 360.0, turn - 360.0).otherwise(turn)


def offset_lat(lat, bearing, metres: float) -> Column:
    """Latitude reached by travelling ``metres`` along ``bearing``."""
    d, p = metres / S.EARTH_RADIUS_M, F.radians(lat)
    return F.degrees(F.asin(F.sin(p) * math.cos(d) + F.cos(p) * math.sin(d) * F.cos(F.radians(bearing))))


def offset_lon(lat, lon, bearing, metres: float, new_lat) -> Column:
    """Longitude that goes with ``offset_lat``."""
    d, p, b = metres / S.EARTH_RADIUS_M, F.radians(lat), F.radians(bearing)
    turn = F.atan2(F.sin(b) * math.sin(d) * F.cos(p), math.cos(d) - F.sin(p) * F.sin(F.radians(new_lat)))
    return F.degrees(F.radians(lon) + turn)


def offset_point(lat, lon, bearing, metres: float) -> Column:
    """struct(lat, lon) of the point reached."""
    new_lat = offset_lat(lat, bearing, metres)
    return F.struct(new_lat.alias("lat"), offset_lon(lat, lon, bearing, metres, new_lat).alias("lon"))


def path_length_m(points: Column) -> Column:
    """Length of an ``array<struct<lat,lon>>`` path: one fold that carries the previous point."""
    start = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(0.0).alias("m"))

    def step(acc, p):
        leg = F.coalesce(haversine_m(acc["lat"], acc["lon"], p["lat"], p["lon"]), F.lit(0.0))
        return F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), (acc["m"] + leg).alias("m"))

    return F.aggregate(points, start, step, lambda acc: acc["m"])


def cell_ring(lat, lon, next_lat, next_lon) -> Column:
    """Closed five-point ring of a grid cell in (lon, lat) order."""
    return F.array(
        F.array(lon, lat), F.array(next_lon, lat), F.array(next_lon, next_lat),
        F.array(lon, next_lat), F.array(lon, lat),
    )


def in_box(lat, lon) -> Column:
    return lat.between(S.LAT_MIN, S.LAT_MAX) & lon.between(S.LON_MIN, S.LON_MAX)
