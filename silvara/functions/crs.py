"""Coordinate systems: checks of a system's code and the transverse Mercator projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from silvara.functions.lookup import utm_zone

# The ellipsoid of the world's geodetic system, and the grid's scale and false origin.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
# Krueger's series to the fourth power, forward, back, and from conformal to geodetic latitude.
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
GEODETIC = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _series(a: Column, b: Column, terms: tuple[float, ...], f, g) -> Column:
    out = F.lit(0.0)
    for j, k in enumerate(terms, 1):
        out = out + k * f(2 * j * a) * g(2 * j * b)
    return out


def to_grid(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres of a position in degrees, in its own zone or ``zone``; south of the equator from the false origin. Null gives null."""
    zone = utm_zone(lon) if zone is None else zone
    away = F.radians(lon) - F.radians(zone * 6.0 - 183.0)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = EAST + SCALE * RADIUS * (eta + _series(xi, eta, FORWARD, F.cos, F.sinh))
    north = SCALE * RADIUS * (xi + _series(xi, eta, FORWARD, F.sin, F.cosh))
    return east, north + F.when(lat < 0, SOUTH).otherwise(0.0)


def to_degrees(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a position on the grid."""
    xi, eta = (north - F.when(south, SOUTH).otherwise(0.0)) / (SCALE * RADIUS), (east - EAST) / (SCALE * RADIUS)
    xi, eta = xi - _series(xi, eta, BACK, F.sin, F.cosh), eta - _series(xi, eta, BACK, F.cos, F.sinh)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum((k * F.sin(2 * j * chi) for j, k in enumerate(GEODETIC, 1)), F.lit(0.0))
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def crs_finding(code: Column, lon: Column, lat: Column) -> Column:
    """What is wrong with working in a system, by its code: 'no valido', 'geografico', 'no metrico' (which block) or 'otra zona' (a warning, if a position of the work lies in another zone); '' if nothing."""
    grid = code.between(32601, 32660) | code.between(32701, 32760)
    own = F.lit(32000) + F.when(lat < 0, 700).otherwise(600) + utm_zone(lon)
    return F.when(code.isNull() | (code <= 0), "no valido").when(code.between(4000, 4999), "geografico").when(~grid, "no metrico").when(lon.isNotNull() & lat.isNotNull() & (code != own), "otra zona").otherwise("")


def node_tolerance(given: Column, cell: Column) -> Column:
    """The tolerance given if above 0, else a third of a cell, at least half a metre."""
    return F.when(given > 0, given).otherwise(F.greatest(F.lit(0.5), cell / 3))
