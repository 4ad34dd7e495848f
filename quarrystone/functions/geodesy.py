"""Earth, tile and Morton arithmetic as column expressions; radians and metres unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84, the sphere of the haversine, metres in a degree, the Mercator limit.
A, FLATTENING, SPHERE_KM, DEGREE_M, MERCATOR_LIMIT = 6378137.0, 1 / 298.257223563, 6371.0, 111320.0, 85.05112878
E2 = FLATTENING * (2 - FLATTENING)
_B = A * (1 - FLATTENING)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance of two places in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE_KM * F.asin(F.sqrt(h))


def to_ecef(lat: Column, lon: Column, height: Column) -> list[Column]:
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return [(n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + height) * F.sin(lat)]


def from_ecef(x: Column, y: Column, z: Column) -> list[Column]:
    """Latitude, longitude and height by Bowring's formula, one step; the height is exact at the poles too."""
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * A, p * _B)
    e2 = (A * A - _B * _B) / (_B * _B)
    lat = F.atan2(z + e2 * _B * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    return [lat, F.atan2(y, x), p * F.cos(lat) + z * F.sin(lat) - A * F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))]


def unwrapped(lat: Column, lon: Column, near_lat: Column, near_lon: Column) -> list[Column]:
    """Of all degrees that mean the place (lat, lon), those nearest to given ones: full turns are added, and past a pole the
    place is 180 - lat on the meridian across."""
    off = lambda p: F.abs(p[0] - near_lat) + F.abs(p[1] - near_lon)
    own, across = ([v + 360 * F.round((near - v) / 360) for v, near in zip(p, (near_lat, near_lon))] for p in ((lat, lon), (180 - lat, lon + 180)))
    return [F.when(off(own) <= off(across), a).otherwise(b) for a, b in zip(own, across)]


def enu_matrix(lat: Column, lon: Column, height: Column) -> Column:
    """The 4 x 4 matrix from east, north, up at a place to ECEF, by columns."""
    sp, cp, sl, cl = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(-sl, cl, zero, zero, -sp * cl, -sp * sl, cp, zero, cp * cl, cp * sl, sp, zero, *to_ecef(lat, lon, height), one)


def mercator(lat: Column, lon: Column) -> list[Column]:
    """EPSG:3857 of degrees."""
    return [F.radians(lon) * A, A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))]


def from_mercator(x: Column, y: Column) -> list[Column]:
    return [F.degrees(F.atan(F.sinh(y / A))), F.degrees(x / A)]


#: Krüger series to n^3 for UTM.
_N = FLATTENING / (2 - FLATTENING)
_AA = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm(lat: Column, lon: Column, zone: int, south: bool = False) -> list[Column]:
    """Easting and northing of degrees in a zone."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [500000 + 0.9996 * _AA * east, (10_000_000 if south else 0) + 0.9996 * _AA * north]


def transform(source: int, target: int, x: Column, y: Column, z: Column) -> list[Column]:
    """Between EPSG codes 4326 (lat, lon in degrees, height), 4978, 3857 and UTM zones 326xx and 327xx; others raise."""
    if source == target:
        return [x, y, z]
    if source == 4326 and target == 4978:
        return to_ecef(F.radians(x), F.radians(y), z)
    if source == 4978 and target == 4326:
        lat, lon, h = from_ecef(x, y, z)
        return [F.degrees(lat), F.degrees(lon), h]
    if source == 4326 and target == 3857:
        return [*mercator(x, y), z]
    if source == 3857 and target == 4326:
        return [*from_mercator(x, y), z]
    if source == 4326 and target // 100 in (326, 327) and 1 <= target % 100 <= 60:
        return [*utm(x, y, target % 100, target // 100 == 327), z]
    raise ValueError(f"no route from EPSG:{source} to EPSG:{target}")


def metres_per_unit(definition: str) -> float:
    """Metres per axis unit of a PROJ string; 1 without a unit."""
    words = dict(w.lstrip("+").split("=", 1) for w in definition.split() if "=" in w)
    if "to_meter" in words:
        return float(words["to_meter"])
    #: Fixed values.
    return {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}.get(words.get("units", "m"), 1.0)


_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Morton code of 21-bit cells."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def unmorton(code: Column) -> list[Column]:
    def gather(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
        masks = [0x10C30C30C30C30C3, 0x100F00F00F00F00F, 0x1F0000FF0000FF, 0x1F00000000FFFF, 0x1FFFFF]
        for shift, mask in zip((2, 4, 8, 16, 32), masks):
            v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return [gather(F.shiftrightunsigned(code, k)) for k in range(3)]


def tile_bounds_mercator(z: Column, x: Column, y: Column) -> list[Column]:
    """West, south, east, north in degrees of a Web Mercator tile; y grows southwards."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return [x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)]


def mercator_unit(lat: Column, lon: Column) -> list[Column]:
    """Place in the unit square of Web Mercator, latitudes held to its limit."""
    phi = F.radians(F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT)))
    return [(lon + 180) / 360, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2]
