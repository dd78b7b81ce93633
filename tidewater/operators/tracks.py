"""Positions between pings on a time grid, and their bearing from a receiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 ellipsoid: semi-major axis in metres and squared eccentricity.
AXIS, ECC2 = 6378137.0, 6.69437999014e-3
KNOT = 1852.0 / 3600.0


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres of a radian of latitude and of longitude."""
    w = F.sqrt(F.lit(1.0) - ECC2 * F.sin(F.radians(lat)) * F.sin(F.radians(lat)))
    return AXIS * (1 - ECC2) / (w * w * w), AXIS * F.cos(F.radians(lat)) / w


def reckoned(lat: Column, lon: Column, knots: Column, course: Column, seconds: Column) -> tuple[Column, Column]:
    """Latitude and longitude after some seconds at a speed and course."""
    north, east = _radii(lat)
    d = knots * KNOT * seconds
    return lat + F.degrees(d * F.cos(F.radians(course)) / north), lon + F.degrees(d * F.sin(F.radians(course)) / east)


def grid(pings: DataFrame, steps: int, every: int, ts: str = "BaseDateTime") -> DataFrame:
    """A row for each of `steps` times, `every` seconds apart from a ping on, at its reckoned place."""
    x = pings.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    s = F.col("step") * every
    lat, lon = reckoned(F.col("LAT"), F.col("LON"), F.col("SOG"), F.col("COG"), s)
    return x.withColumn("timestamp", F.timestamp_add("SECOND", s, F.col(ts))).withColumn("lat_at", lat).withColumn("lon_at", lon)


def bearing(lat: Column, lon: Column, depth: Column, at_lat: Column, at_lon: Column) -> tuple[Column, Column, Column]:
    """(azimuth, elevation, range) in degrees and metres of a place at the surface from a receiver at a depth."""
    north, east = _radii(at_lat)
    y, x = F.radians(lat - at_lat) * north, F.radians(lon - at_lon) * east
    flat = F.sqrt(x * x + y * y)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0)), F.degrees(F.atan2(depth, flat)), F.sqrt(flat * flat + depth * depth)
