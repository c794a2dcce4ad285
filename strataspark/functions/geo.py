"""Distances, local frames and the Lambert conformal conic projection, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

EARTH_KM, METRES_PER_DEGREE = 6371.0088, 111_320.0
_RAD = math.pi / 180


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance; the argument of the arc sine is held at 1."""
    lon1, lat1, lon2, lat2 = (col(c) if not isinstance(c, (int, float)) else F.lit(float(c)) for c in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) * (_RAD / 2)), 2) + F.cos(lat1 * _RAD) * F.cos(lat2 * _RAD) * F.pow(F.sin((lon2 - lon1) * (_RAD / 2)), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_local(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin (equirectangular)."""
    return (col(lon) - lon0) * (METRES_PER_DEGREE * math.cos(lat0 * _RAD)), (col(lat) - lat0) * METRES_PER_DEGREE


def from_local(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    return col(x) / (METRES_PER_DEGREE * math.cos(lat0 * _RAD)) + lon0, col(y) / METRES_PER_DEGREE + lat0


def bearing_of(var_x, var_y, cov) -> Column:
    """Bearing (0 to 180) of the principal axis of a point cloud from its moments."""
    theta = F.atan2(2 * col(cov), col(var_x) - col(var_y)) / 2
    return F.pmod(90 - theta / _RAD, F.lit(180.0))


def undirected_gap(a, b) -> Column:
    """Difference of two bearings without direction: 0 to 90."""
    d = F.pmod(F.abs(col(a) - b), F.lit(180.0))
    return F.least(d, 180 - d)


@dataclass(frozen=True)
class Lcc:
    """Lambert conformal conic with two standard parallels on an ellipsoid; the defaults are the Canada Atlas grid."""

    lat1: float = 49.0
    lat2: float = 77.0
    lat0: float = 49.0
    lon0: float = -95.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257222101

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _m(self, lat: float) -> float:
        s = math.sin(lat)
        return math.cos(lat) / math.sqrt(1 - (self.e * s) ** 2)

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    @property
    def cone(self) -> tuple[float, float, float]:
        """Cone constant, scale and radius at the origin."""
        p1, p2 = self.lat1 * _RAD, self.lat2 * _RAD
        n = (math.log(self._m(p1)) - math.log(self._m(p2))) / (math.log(self._t(p1)) - math.log(self._t(p2)))
        f = self._m(p1) / (n * self._t(p1) ** n)
        return n, f, self.a * f * self._t(self.lat0 * _RAD) ** n

    def forward(self, lon, lat) -> tuple[Column, Column]:
        """x, y in metres; NULL at and beyond the poles."""
        n, f, rho0 = self.cone
        phi = F.when(F.abs(col(lat)) < 90, col(lat) * _RAD)
        s = F.sin(phi) * self.e
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        rho = F.pow(t, F.lit(n)) * (self.a * f)
        theta = (col(lon) - self.lon0) * (n * _RAD)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x, y, steps: int = 12) -> tuple[Column, Column]:
        """lon, lat; a fixed number of steps, far past convergence, keeps it one expression."""
        n, f, rho0 = self.cone
        x, y = col(x), rho0 - col(y)
        rho = F.sqrt(x * x + y * y)
        t = F.pow(rho / (self.a * f), F.lit(1 / n))
        half = self.e / 2

        def step(phi: Column, _: Column) -> Column:
            s = F.sin(phi) * self.e
            return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(half)))

        phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), math.pi / 2 - 2 * F.atan(t), step)
        return F.atan2(x, y) / (n * _RAD) + self.lon0, phi / _RAD
