"""Polar stereographic projections as column expressions (Snyder 1987, south polar aspect)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

#: Ellipsoids: semi-major axis and eccentricity squared.
WGS84 = (6378137.0, (2 - 1 / 298.257223563) / 298.257223563)
HUGHES = (6378273.0, 1 - (6356889.44891 / 6378273.0) ** 2)


def _t(phi: float, e: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)


def _scale(ellipsoid: tuple[float, float], parallel: float) -> float:
    """rho / t: the distance from the pole per unit of t."""
    a, e2 = ellipsoid
    phi = math.radians(parallel)
    return a * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2) / _t(phi, math.sqrt(e2))


def latitude(x: Column, y: Column, ellipsoid: tuple[float, float] = WGS84, parallel: float = params.STANDARD_PARALLEL) -> Column:
    """Degrees, south negative, of a point in metres."""
    e2 = ellipsoid[1]
    t = F.sqrt(x * x + y * y) / _scale(ellipsoid, parallel)
    chi = math.pi / 2 - 2 * F.atan(t)
    series = (
        (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 2),
        (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 4),
        (7 * e2**3 / 120 + 81 * e2**4 / 1120, 6),
        (4279 * e2**4 / 161280, 8),
    )
    phi = chi
    for factor, times in series:
        phi = phi + factor * F.sin(times * chi)
    return -F.degrees(phi)


def longitude(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def forward(lat: Column, lon: Column, ellipsoid: tuple[float, float] = WGS84, parallel: float = params.STANDARD_PARALLEL) -> tuple[Column, Column]:
    """x and y in metres of a point in degrees."""
    e = math.sqrt(ellipsoid[1])
    phi, lam = F.radians(-lat), F.radians(lon)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho = _scale(ellipsoid, parallel) * t
    return rho * F.sin(lam), rho * F.cos(lam)


def sic_kilometres(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3031 metres to the sea-ice grid's kilometres (its own ellipsoid, true at 70 degrees)."""
    gx, gy = forward(latitude(x, y), longitude(x, y), HUGHES, 70.0)
    return gx / 1000, gy / 1000


def scale_factor(lat: Column, kind: str = "coded") -> Column:
    """The factor k of the area correction res**2 / k**2.

    coded: the spherical formula as the pipeline has it, (1 + sin |lat|) / (1 + sin 71). snyder: its
    textbook reciprocal, which corrects the area the right way.
    """
    own = 1 + F.sin(F.radians(F.abs(lat)))
    at = 1 + math.sin(math.radians(params.STANDARD_PARALLEL))
    if kind == "coded":
        return own / at
    if kind == "snyder":
        return at / own
    raise ValueError(f"unknown scale {kind!r}")


def true_area_km2(resolution: Column, lat: Column, kind: str = "coded") -> Column:
    k = scale_factor(lat, kind)
    return resolution * resolution / (k * k) / 1e6


def forward_points(lon, lat, ellipsoid: tuple[float, float] = WGS84, parallel: float = params.STANDARD_PARALLEL):
    """forward() of numpy arrays of degrees."""
    import numpy as np

    e = math.sqrt(ellipsoid[1])
    phi, lam = np.radians(-np.asarray(lat, dtype=float)), np.radians(np.asarray(lon, dtype=float))
    rho = _scale(ellipsoid, parallel) * np.tan(math.pi / 4 - phi / 2) / ((1 - e * np.sin(phi)) / (1 + e * np.sin(phi))) ** (e / 2)
    return rho * np.sin(lam), rho * np.cos(lam)
