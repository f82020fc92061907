"""UTM to WGS84 and back as closed-form Krueger series on the WGS84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the UTM frame.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
ECCENTRICITY = 2 * _N**0.5 / (1 + _N)


def is_utm(wkid: Column) -> Column:
    return (wkid.between(32601, 32660)) | (wkid.between(32701, 32760))


def _checked(wkid: Column) -> Column:
    message = F.concat(F.lit("only UTM zones and 4326 are supported, got "), wkid.cast("string"))
    return F.when(is_utm(wkid), wkid % 100).otherwise(F.raise_error(message).cast("int"))


def _north_offset(wkid: Column) -> Column:
    return F.when(wkid > 32700, FALSE_NORTHING_SOUTH).otherwise(0.0)


def utm_to_wgs84(x: Column, y: Column, wkid: Column) -> Column:
    """struct<lat, lon> in degrees; raises on any other coordinate system."""
    zone = _checked(wkid)
    xi = (y - _north_offset(wkid)) / (SCALE * RECTIFYING)
    eta = (x - FALSE_EASTING) / (SCALE * RECTIFYING)
    xi0, eta0 = xi, eta
    for j, beta in enumerate(BETA, 1):
        xi0 = xi0 - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, delta in enumerate(DELTA, 1):
        lat = lat + delta * F.sin(2 * j * chi)
    lon = F.radians(zone * 6.0 - 183.0) + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def wgs84_to_utm(lat: Column, lon: Column, wkid: Column) -> Column:
    """struct<x, y> in the UTM zone named by ``wkid``."""
    zone = _checked(wkid)
    phi = F.radians(lat)
    dlon = F.radians(lon) - F.radians(zone * 6.0 - 183.0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi0 = F.atan2(t, F.cos(dlon))
    eta0 = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, alpha in enumerate(ALPHA, 1):
        xi = xi + alpha * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + alpha * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return F.struct(
        (FALSE_EASTING + SCALE * RECTIFYING * eta).alias("x"),
        (_north_offset(wkid) + SCALE * RECTIFYING * xi).alias("y"),
    )
