"""Map projections between degrees and metres: transverse Mercator by Krueger's series, both ways, and spherical Mercator.

The same formulas serve columns and arrays: they only use the functions of a module of sines and the like. Series go to the sixth order of the third
flattening, which is far below a millimetre within a zone's neighbourhood.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, asin=F.asin, asinh=F.asinh, atanh=F.atanh, atan2=F.atan2, exp=F.exp, atan=F.atan, sqrt=F.sqrt)
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, asinh=np.arcsinh, atanh=np.arctanh, atan2=np.arctan2, exp=np.exp, atan=np.arctan, sqrt=np.sqrt)

# Coefficients of powers of the third flattening, from the first that isn't zero, for each multiple of the angle.
FORWARD = (("1/2", "-2/3", "5/16", "41/180", "-127/288", "7891/37800"), ("13/48", "-3/5", "557/1440", "281/630", "-1983433/1935360"), ("61/240", "-103/140", "15061/26880", "167603/181440"), ("49561/161280", "-179/168", "6601661/7257600"), ("34729/80640", "-3418889/1995840"), ("212378941/319334400",))
INVERSE = (("1/2", "-2/3", "37/96", "-1/360", "-81/512", "96199/604800"), ("1/48", "1/15", "-437/1440", "46/105", "-1118711/3870720"), ("17/480", "-37/840", "-209/4480", "5569/90720"), ("4397/161280", "-11/504", "-830251/7257600"), ("4583/161280", "-108847/3991680"), ("20648693/638668800",))
LATITUDE = (("2", "-2/3", "-2", "116/45", "26/45", "-2854/675"), ("7/3", "-8/5", "-227/45", "2704/315", "2323/945"), ("56/15", "-136/35", "-1262/105", "73814/2835"), ("4279/630", "-332/35", "-399572/14175"), ("4174/315", "-144838/6237"), ("601676/22275",))
#: Axis and inverse flattening of WGS 84.
AXIS, INVERSE_FLATTENING = 6378137.0, 298.257223563


def _series(table: tuple[tuple[str, ...], ...], n: float) -> list[float]:
    return [sum(float(Fraction(c)) * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(table, 1)]


@dataclass(frozen=True)
class TransverseMercator:
    """A zone: its central meridian, the scale on it, and what is added to coordinates."""

    meridian: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    axis: float = AXIS
    inverse_flattening: float = INVERSE_FLATTENING

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def radius(self) -> float:
        """Of the circle as long as a meridian, times the scale."""
        return self.scale * self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64 + self.n**6 / 256)

    def forward(self, lon, lat, m=ARRAYS):
        """Metres east and north of degrees."""
        e = 2 * math.sqrt(self.n) / (1 + self.n)
        own, away = lat * (math.pi / 180), (lon - self.meridian) * (math.pi / 180)
        t = m.sinh(m.atanh(m.sin(own)) - e * m.atanh(e * m.sin(own)))
        up, side = m.atan2(t, m.cos(away)), m.asinh(m.sin(away) / m.sqrt(t * t + m.cos(away) * m.cos(away)))
        a = _series(FORWARD, self.n)
        x = sum((c * m.cos(2 * j * up) * m.sinh(2 * j * side) for j, c in enumerate(a, 1)), side)
        y = sum((c * m.sin(2 * j * up) * m.cosh(2 * j * side) for j, c in enumerate(a, 1)), up)
        return self.east + self.radius * x, self.north + self.radius * y

    def inverse(self, x, y, m=ARRAYS):
        """Degrees of longitude and latitude of metres."""
        side, up = (x - self.east) / self.radius, (y - self.north) / self.radius
        b = _series(INVERSE, self.n)
        s = sum((-c * m.cos(2 * j * up) * m.sinh(2 * j * side) for j, c in enumerate(b, 1)), side)
        u = sum((-c * m.sin(2 * j * up) * m.cosh(2 * j * side) for j, c in enumerate(b, 1)), up)
        conformal = m.asin(m.sin(u) / m.cosh(s))
        lat = sum((d * m.sin(2 * j * conformal) for j, d in enumerate(_series(LATITUDE, self.n), 1)), conformal)
        return self.meridian + m.atan2(m.sinh(s), m.cos(u)) * (180 / math.pi), lat * (180 / math.pi)


@dataclass(frozen=True)
class Degrees:
    """Longitude and latitude themselves."""

    def forward(self, lon, lat, m=ARRAYS):
        return lon, lat

    inverse = forward


@dataclass(frozen=True)
class SphericalMercator:
    """The system of web maps. Its metres are true at the equator only, so it's read and not measured in."""

    def inverse(self, x, y, m=ARRAYS):
        return x * (180 / math.pi / AXIS), (2 * m.atan(m.exp(y / AXIS)) - math.pi / 2) * (180 / math.pi)


def system(code: int | str) -> TransverseMercator | Degrees | SphericalMercator:
    """The system of an EPSG number: 4326, 3857, and the zones 326xx (north) and 327xx (south)."""
    number = int(re.fullmatch(r"(?:EPSG:)?(\d+)", str(code).strip(), re.IGNORECASE)[1]) if re.fullmatch(r"(?:EPSG:)?\d+", str(code).strip(), re.IGNORECASE) else -1
    if number == 4326:
        return Degrees()
    if number == 3857:
        return SphericalMercator()
    if number // 100 in (326, 327) and 1 <= number % 100 <= 60:
        return TransverseMercator(6 * (number % 100) - 183, north=0.0 if number // 100 == 326 else 10_000_000.0)
    raise ValueError(f"no rule for the reference system {code}")


def metric(code: int | str) -> TransverseMercator:
    """A system whose coordinates are metres, or an error."""
    found = system(code)
    if not isinstance(found, TransverseMercator):
        raise ValueError(f"coordinates of {code} aren't metres: name a projected system")
    return found


def reprojected(df: DataFrame, x: str, y: str, source: int | str, target: int | str, to: tuple[str, str] = ("x_m", "y_m")) -> DataFrame:
    """df with the points (x, y) of one system as metres of another, in columns ``to``."""
    start, end = system(source), metric(target)
    if start == end:
        return df.withColumns({to[0]: F.col(x).cast("double"), to[1]: F.col(y).cast("double")})
    lon, lat = start.inverse(F.col(x).cast("double"), F.col(y).cast("double"), COLUMNS)
    df = df.withColumns({"_lon": lon, "_lat": lat})
    east, north = end.forward(F.col("_lon"), F.col("_lat"), COLUMNS)
    return df.withColumns({to[0]: east, to[1]: north}).drop("_lon", "_lat")
