"""Coordinates."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# fixed values: the published ellipsoid of the GCJ-02 transformation
AXIS = 6378245.0
ECCENTRICITY2 = 0.00669342162296594323


def _waves(x: Column, amplitudes) -> Column:
    total = F.lit(0.0)
    for scale, parts in amplitudes:
        total = total + sum(F.sin(x * (f * pi)) * a for f, a in parts) * scale
    return total


def gcj_to_wgs(lat, lng):
    """(lat, lng) in WGS-84 of a GCJ-02 point, by subtracting the offset taken at that point."""
    lat, lng = col(lat), col(lng)
    x, y = lng - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    common = _waves(x, [(2 / 3, [(6.0, 20.0), (2.0, 20.0)])])
    d_lat = -100.0 + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + root * 0.2 + common + _waves(y, [(2 / 3, [(1.0, 20.0), (1 / 3, 40.0), (1 / 12, 160.0), (1 / 30, 320.0)])])
    d_lng = 300.0 + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + root * 0.1 + common + _waves(x, [(2 / 3, [(1.0, 20.0), (1 / 3, 40.0), (1 / 12, 150.0), (1 / 30, 300.0)])])
    rad = F.radians(lat)
    magic = 1 - ECCENTRICITY2 * F.sin(rad) * F.sin(rad)
    d_lat = F.degrees(d_lat / ((AXIS * (1 - ECCENTRICITY2)) / (magic * F.sqrt(magic))))
    d_lng = F.degrees(d_lng / (AXIS / F.sqrt(magic) * F.cos(rad)))
    return lat - d_lat, lng - d_lng


def convert(point, in_format: str = "lnglat", out_format: str = "latlng") -> Column:
    """A two-element array converted to WGS-84, with the axis order of either side."""
    p = col(point)
    a, b = (p[1], p[0]) if in_format == "lnglat" else (p[0], p[1])
    lat, lng = gcj_to_wgs(a, b)
    return F.array(lng, lat) if out_format == "lnglat" else F.array(lat, lng)
