"""Geometry on the sphere and the WGS84 ellipsoid."""

from __future__ import annotations

from math import radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6_371_000.0
# Semi-major axis and flattening of WGS84.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def not_nan(c: Column) -> Column:
    """NaN as null, the only missing value inside the library."""
    return F.when(~F.isnan(c), c)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def wrap_longitude(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def shortest_turn(lon1: Column, lon2: Column) -> Column:
    """Degrees from lon1 to lon2 the short way; exactly half a turn keeps its sign."""
    d = lon2 - lon1
    return F.when(F.abs(d) == 180.0, d).otherwise(wrap_longitude(d))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def chord_to_metres(chord: Column) -> Column:
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.greatest(chord / 2, F.lit(0.0)), F.lit(1.0)))


def by_bisection(turn: np.ndarray, u1: np.ndarray, u2: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Forward azimuth (degrees) and distance, from the difference of longitude and the reduced latitudes in radians.

    The longitude reached from the point that is farther from the equator, put in the south,
    grows with the azimuth there, for nearly antipodal points too; so the azimuth is halved
    to. Ends and signs are put back after that.
    """
    swapped = np.abs(u2) > np.abs(u1)
    a, b = np.where(swapped, u2, u1), np.where(swapped, u1, u2)
    north, east = np.where(a > 0, -1.0, 1.0), np.where(turn < 0, -1.0, 1.0)
    s1, c1, s2 = np.minimum(-1e-160, north * np.sin(a)), np.cos(a), north * np.sin(b)

    def arc(alpha: np.ndarray) -> tuple:
        """On the auxiliary sphere: sine at the equator, cosines towards north at both ends (times those of latitude), arc, its middle's cosine, longitude reached."""
        s0, ca = np.sin(alpha) * c1, np.cos(alpha) * c1
        cb = np.sqrt(np.maximum(0.0, ca * ca + (s1 - s2) * (s1 + s2)))
        n, m = np.hypot(s1, ca) * np.hypot(s2, cb), np.hypot(s0 * s1, ca) * np.hypot(s0 * s2, cb)
        sigma = np.arctan2(np.maximum(0.0, (ca * s2 - s1 * cb) / n), (ca * cb + s1 * s2) / n)
        omega = np.arctan2(np.maximum(0.0, s0 * (ca * s2 - s1 * cb) / m), (ca * cb + s0 * s0 * s1 * s2) / m)
        middle, c0 = (ca * cb - s1 * s2) / n, 1 - s0 * s0
        c = WGS84_F / 16 * c0 * (4 + WGS84_F * (4 - 3 * c0))
        ahead = (1 - c) * WGS84_F * s0 * (sigma + c * np.sin(sigma) * (middle + c * np.cos(sigma) * (2 * middle**2 - 1)))
        return s0, ca, cb, sigma, middle, omega - ahead

    low, high, want = np.zeros(len(turn)), np.full(len(turn), np.pi), np.abs(turn)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            half = (low + high) / 2
            over = arc(half)[-1] > want
            low, high = np.where(over, low, half), np.where(over, half, high)
        s0, ca, cb, sigma, middle, _ = arc((low + high) / 2)
    b_axis = WGS84_A * (1 - WGS84_F)
    k = (1 - s0 * s0) * (WGS84_A**2 - b_axis**2) / b_axis**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    ss, cs = np.sin(sigma), np.cos(sigma)
    fix = small * ss * (middle + small / 4 * (cs * (2 * middle**2 - 1) - small / 6 * middle * (4 * ss**2 - 3) * (4 * middle**2 - 3)))
    azimuth = np.arctan2(east * np.where(swapped, -s0, s0), north * np.where(swapped, -cb, ca))
    return np.degrees(azimuth), b_axis * big * (sigma - fix)


def inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """Forward azimuth (degrees) and distance (metres) on WGS84, by Vincenty's inverse formulae.

    Equal points have distance 0 and azimuth 0; pairs that do not settle (nearly antipodal
    ones) are solved by bisection.
    """
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, np.float64)) for x in (lon1, lat1, lon2, lat2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(x)) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    turn = np.where(np.abs(lon2 - lon1) == np.pi, lon2 - lon1, (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi)
    lam, done = turn.copy(), np.zeros(turn.shape, bool)

    def arc(lam: np.ndarray) -> tuple:
        """On the auxiliary sphere, for a difference of longitude there: sine, cosine and arc, square of the cosine of the azimuth at the equator, the middle's cosine, next difference."""
        sl, cl = np.sin(lam), np.cos(lam)
        sin_sigma = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_sigma = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_sigma, cos_sigma)
        sin_alpha = np.where(sin_sigma > 0, c1 * c2 * sl / sin_sigma, 0.0)
        cos2_alpha = 1 - sin_alpha**2
        cos_2m = np.where(cos2_alpha > 0, cos_sigma - 2 * s1 * s2 / cos2_alpha, 0.0)
        c = WGS84_F / 16 * cos2_alpha * (4 + WGS84_F * (4 - 3 * cos2_alpha))
        new = turn + (1 - c) * WGS84_F * sin_alpha * (sigma + c * sin_sigma * (cos_2m + c * cos_sigma * (2 * cos_2m**2 - 1)))
        return sin_sigma, cos_sigma, sigma, cos2_alpha, cos_2m, new

    with np.errstate(all="ignore"):
        for _ in range(20):
            new = arc(lam)[-1]
            settled = (np.abs(new - lam) < 1e-13) & (np.abs(new) <= np.pi)
            lam = np.where(done, lam, new)
            done |= settled
            if (done | ~np.isfinite(lam)).all():
                break
        # Settled pairs stand still, and all are taken from where they stand: a pair's result does not depend on the others of its batch.
        sin_sigma, cos_sigma, sigma, cos2_alpha, cos_2m, _ = arc(lam)
        k = cos2_alpha * (WGS84_A**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        fix = small * sin_sigma * (cos_2m + small / 4 * (cos_sigma * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_sigma**2 - 3) * (4 * cos_2m**2 - 3)))
        distance = np.where(done, b * big * (sigma - fix), np.nan)
        azimuth = np.where(done, np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))), np.nan)
    far = ~done & np.isfinite(turn) & np.isfinite(u1) & np.isfinite(u2)
    if far.any():
        azimuth[far], distance[far] = by_bisection(turn[far], u1[far], u2[far])
    same = (lon1 == lon2) & (lat1 == lat2)
    return np.where(same, 0.0, azimuth), np.where(same, 0.0, distance)


def with_geodesic(df: DataFrame, lon1: Column, lat1: Column, lon2: Column, lat2: Column, *, azimuth: str = "azimuth_deg", distance: str = "distance_m") -> DataFrame:
    """``df`` with the forward azimuth at the first point (degrees) and the distance (metres) on WGS84, null where an end is null.

    Rows go through Arrow and are computed in batches: the same rounds as columns, in
    generated code too long to be compiled, took several times as long.
    """

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        degrees, metres = inverse(a, b, c, d)
        return pd.DataFrame({"azimuth_deg": degrees, "distance_m": metres})

    kind = T.StructType([T.StructField("azimuth_deg", T.DoubleType()), T.StructField("distance_m", T.DoubleType())])
    rows = df.withColumn("_geodesic", F.pandas_udf(run, kind)(lon1, lat1, lon2, lat2))
    return rows.select(*df.columns, not_nan(F.col("_geodesic.azimuth_deg")).alias(azimuth), not_nan(F.col("_geodesic.distance_m")).alias(distance))


def cube_side(max_distance_m: float) -> float:
    """Side of cubes on the unit sphere such that points that near are in neighbouring cubes."""
    half = min(max_distance_m / (2 * EARTH_RADIUS_M), radians(90))
    return 2 * sin(half) * 1.0001
