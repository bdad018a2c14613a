"""Map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two ellipsoids and the parameters of the two map systems.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
POLAR_TRUE_SCALE_LAT = -71.0
KOREA_LAT0, KOREA_LON0, KOREA_K0, KOREA_FE, KOREA_FN = 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0


def project_epsg3031(lat: Column, lon: Column) -> tuple[Column, Column]:
    """South polar stereographic, in km, with y growing downwards."""
    e = math.sqrt(WGS84_F * (2 - WGS84_F))

    def isometric(phi_sin: float, phi: float) -> float:
        return math.tan(math.pi / 4 + phi / 2) / ((1 + e * phi_sin) / (1 - e * phi_sin)) ** (e / 2)

    true = math.radians(POLAR_TRUE_SCALE_LAT)
    scale = WGS84_A * math.cos(true) / math.sqrt(1 - (e * math.sin(true)) ** 2) / isometric(math.sin(true), true)
    phi, lam = F.radians(lat), F.radians(lon)
    es = F.sin(phi) * e
    t = F.tan(phi / 2 + math.pi / 4) / F.pow((es + 1) / (F.lit(1.0) - es), F.lit(e / 2))
    rho = t * (scale / 1000)
    return rho * F.sin(lam), -rho * F.cos(lam)


def project_epsg5179(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Korean transverse Mercator, in m, with y growing downwards (series of the standard formulas)."""
    e2 = GRS80_F * (2 - GRS80_F)
    ep2 = e2 / (1 - e2)
    # Meridian arc: coefficients of phi, sin 2phi, sin 4phi, sin 6phi.
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    m2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    m4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    m6 = 35 * e2**3 / 3072
    p0 = math.radians(KOREA_LAT0)
    arc0 = GRS80_A * (m0 * p0 - m2 * math.sin(2 * p0) + m4 * math.sin(4 * p0) - m6 * math.sin(6 * p0))
    phi = F.radians(lat)
    arc = (phi * m0 - F.sin(phi * 2) * m2 + F.sin(phi * 4) * m4 - F.sin(phi * 6) * m6) * GRS80_A
    tan2, c = F.pow(F.tan(phi), F.lit(2.0)), F.pow(F.cos(phi), F.lit(2.0)) * ep2
    nu = F.lit(GRS80_A) / F.sqrt(F.lit(1.0) - F.pow(F.sin(phi), F.lit(2.0)) * e2)
    a = F.radians(lon - KOREA_LON0) * F.cos(phi)

    def series(*terms: Column) -> Column:
        """Horner form in a squared."""
        out = terms[-1]
        for t in reversed(terms[:-1]):
            out = t + out * a * a
        return out

    one = F.lit(1.0)
    east = series(one, (one - tan2 + c) / 6, (tan2 * tan2 - tan2 * 18 + c * 72 + (5 - 58 * ep2)) / 120) * a
    north = series(
        one / 2, (c * c * 4 + c * 9 - tan2 + 5) / 24, (tan2 * tan2 - tan2 * 58 + c * 600 + (61 - 330 * ep2)) / 720
    )
    x = nu * east * KOREA_K0 + KOREA_FE
    y = (arc - arc0 + nu * F.tan(phi) * north * a * a) * KOREA_K0 + KOREA_FN
    return x, -y
