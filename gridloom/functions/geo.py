"""Places: UTM zones and coordinates, pixels, tile names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the scale of UTM.
AXIS, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6) + 1
    return (zone + F.when(lat >= 0, 32600).otherwise(32700)).cast("long")


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in the zone of the place, by the Krueger series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    middle = (F.floor((lon + 180) / 6) + 1) * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - middle)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.pow(F.cos(lam), 2)))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000 + UTM_SCALE * radius * x, F.when(lat < 0, 1e7).otherwise(0.0) + UTM_SCALE * radius * y


def lonlat(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of UTM coordinates in the zone of an EPSG code, by the Krueger series to the fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = (northing - F.when(epsg >= 32700, 1e7).otherwise(0.0)) / (UTM_SCALE * radius)
    eta = (easting - 500000) / (UTM_SCALE * radius)
    x, y = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for k, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * k * chi)
    middle = (epsg % 100) * 6 - 183
    return middle + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def bounds_lonlat(left: Column, bottom: Column, right: Column, top: Column, epsg: Column, points: int = 21) -> Column:
    """A struct west, south, east, north that holds a rectangle of UTM coordinates: each edge is followed by ``points``
    places between its ends, since it is no line of equal longitude or latitude.  A rectangle over the date line or a pole
    is out of a zone's reach and not provided for."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda k: k / F.lit(points + 1.0))
    across = lambda y: F.transform(steps, lambda s: F.struct((left + s * (right - left)).alias("x"), y.alias("y")))
    along = lambda x: F.transform(steps, lambda s: F.struct(x.alias("x"), (bottom + s * (top - bottom)).alias("y")))
    edge = F.concat(across(bottom), across(top), along(left), along(right))

    def place(p: Column) -> Column:
        lon, lat = lonlat(p["x"], p["y"], epsg)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    places = F.transform(edge, place)
    lon, lat = F.transform(places, lambda p: p["lon"]), F.transform(places, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def degree_metres(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of longitude and of latitude."""
    return 111320 * F.cos(F.radians(lat)), F.lit(110540.0)


def tile_names(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Names of the one-degree elevation tiles that cover the bounds, an array."""
    lats, lons = (F.sequence(F.floor(a).cast("int"), F.greatest(F.floor(a), F.ceil(b) - 1).cast("int")) for a, b in ((south, north), (west, east)))

    def part(v: Column, positive: str, negative: str, digits: int) -> Column:
        return F.concat(F.when(v >= 0, positive).otherwise(negative), F.lpad(F.abs(v).cast("string"), digits, "0"), F.lit("_00"))

    return F.flatten(
        F.transform(lats, lambda y: F.transform(lons, lambda x: F.concat(F.lit("Copernicus_DSM_COG_10_"), part(y, "N", "S", 2), F.lit("_"), part(x, "E", "W", 3), F.lit("_DEM"))))
    )


def cell_at(share: Column, size: Column | int) -> Column:
    """The cell that a place from 0 to 1 falls into; places beyond fall into the first or last."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.greatest(F.lit(0), F.least(n - 1, (share * n).cast("long"))).cast("long")


def place_of(cell: Column, size: Column | int) -> Column:
    """The middle of a cell as a place from 0 to 1."""
    return (cell + 0.5) / (F.lit(size) if isinstance(size, int) else size)
