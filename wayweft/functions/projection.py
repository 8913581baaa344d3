"""Map projections in closed form, for Columns and for plain numbers alike.

UTM by the Krüger series in the third flattening, Lambert conformal conic with two standard parallels after Snyder.
The same code runs with pyspark.sql.functions (on Columns) and with math (on numbers).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of the ellipsoids, and metres per unit.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "NAD83": (6378137.0, 298.257222101)}
METRES_PER_UNIT = {"m": 1.0, "ft": 0.3048, "us-ft": 1200 / 3937}


class _Numbers:
    """math with the names of pyspark.sql.functions."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, exp, log, sqrt = math.sin, math.cos, math.tan, math.atan, math.atan2, math.sinh, math.cosh, math.asinh, math.atanh, math.exp, math.log, math.sqrt
    radians, degrees, pow = math.radians, math.degrees, math.pow


@dataclass(frozen=True)
class Projection:
    """A planar reference system; make one with parse_proj4()."""

    kind: str
    a: float
    inverse_flattening: float
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    x0: float = 0.0  # metres
    y0: float = 0.0
    scale: float = 1.0
    to_metre: float = 1.0

    @property
    def units(self) -> str:
        return "feet" if self.to_metre < 1 else "meters"

    def _eccentricity(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _krueger(self):
        f = 1 / self.inverse_flattening
        n = f / (2 - f)
        radius = self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        return radius, alpha, beta

    def _geodetic(self, chi, m):
        """Geodetic from conformal latitude by a series, so that no expression contains itself again."""
        f = 1 / self.inverse_flattening
        n = f / (2 - f)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        phi = chi
        for j, c in enumerate(delta, 1):
            phi = phi + m.sin(chi * (2 * j)) * c
        return phi

    def _cone(self):
        e = self._eccentricity()
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p0, p1, p2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        n = math.sin(p1) if p1 == p2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        big_f = m(p1) / (n * t(p1) ** n)
        return e, n, big_f, self.a * big_f * t(p0) ** n

    def _forward(self, lon, lat, m):
        if self.kind == "longlat":
            return lon, lat
        lam, phi = m.radians(lon - self.lon0), m.radians(lat)
        e = self._eccentricity()
        if self.kind == "tmerc":
            radius, alpha, _ = self._krueger()
            t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
            xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
            x, y = eta, xi
            for j, c in enumerate(alpha, 1):
                x = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
                y = y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            x, y = x * (self.scale * radius), y * (self.scale * radius)
        else:
            e, n, big_f, rho0 = self._cone()
            t = m.tan(math.pi / 4 - phi / 2) / m.pow((1 - e * m.sin(phi)) / (1 + e * m.sin(phi)), e / 2)
            rho, theta = m.pow(t, n) * (self.a * big_f), lam * n
            x, y = rho * m.sin(theta), rho0 - rho * m.cos(theta)
        return (x + self.x0) / self.to_metre, (y + self.y0) / self.to_metre

    def _backward(self, x, y, m):
        if self.kind == "longlat":
            return x, y
        x, y = x * self.to_metre - self.x0, y * self.to_metre - self.y0
        e = self._eccentricity()
        if self.kind == "tmerc":
            radius, _, beta = self._krueger()
            xi, eta = y / (self.scale * radius), x / (self.scale * radius)
            xi0, eta0 = xi, eta
            for j, c in enumerate(beta, 1):
                xi0 = xi0 - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
                eta0 = eta0 - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            chi = m.atan2(m.sin(xi0), m.sqrt(m.sinh(eta0) * m.sinh(eta0) + m.cos(xi0) * m.cos(xi0)))
            lam, phi = m.atan2(m.sinh(eta0), m.cos(xi0)), self._geodetic(chi, m)
        else:
            e, n, big_f, rho0 = self._cone()
            sign = 1.0 if n >= 0 else -1.0
            rho = m.sqrt(x * x + (rho0 - y) * (rho0 - y)) * sign
            lam = m.atan2(x * sign, (rho0 - y) * sign) / n
            t = m.pow(rho / (self.a * big_f), 1 / n)
            phi = self._geodetic(math.pi / 2 - m.atan(t) * 2, m)
        return m.degrees(lam) + self.lon0, m.degrees(phi)

    def point(self, p: Column, reverse: bool = False) -> Column:
        """A point of lon, lat to the plane, or back."""
        x, y = (self._backward if reverse else self._forward)(p["x"], p["y"], F)
        return F.struct(x.alias("x"), y.alias("y"))

    def line(self, pts: Column, reverse: bool = False) -> Column:
        return F.transform(pts, lambda p: self.point(p, reverse))

    def numbers(self, x: float, y: float, reverse: bool = False) -> tuple[float, float]:
        return (self._backward if reverse else self._forward)(float(x), float(y), _Numbers)

    def box(self, box: tuple[float, float, float, float], reverse: bool = False) -> tuple[float, float, float, float]:
        """The two corners, projected."""
        return (*self.numbers(box[0], box[1], reverse), *self.numbers(box[2], box[3], reverse))


def parse_proj4(text: str) -> Projection:
    """proj4 text of utm, tmerc, lcc or longlat."""
    args = {k: v for k, _, v in (w.lstrip("+").partition("=") for w in text.split() if w.startswith("+"))}
    kind = args.get("proj", "")
    a, rf = ELLIPSOIDS[args.get("ellps") or args.get("datum") or "WGS84"]
    to_metre = float(args["to_meter"]) if "to_meter" in args else METRES_PER_UNIT[args.get("units", "m")]
    number = lambda k, d=0.0: float(args.get(k, d))
    if kind == "utm":
        zone = int(args["zone"])
        if not 1 <= zone <= 60:
            raise ValueError(f"there is no UTM zone {zone}")
        return Projection("tmerc", a, rf, lon0=zone * 6 - 183, x0=500_000.0, y0=10_000_000.0 if "south" in args else 0.0, scale=0.9996, to_metre=to_metre)
    if kind == "tmerc" and number("lat_0") == 0:
        return Projection("tmerc", a, rf, lon0=number("lon_0"), x0=number("x_0"), y0=number("y_0"), scale=number("k", args.get("k_0", 1.0)), to_metre=to_metre)
    if kind == "lcc":
        return Projection("lcc", a, rf, lon0=number("lon_0"), lat0=number("lat_0"), lat1=number("lat_1"), lat2=number("lat_2", args.get("lat_1", 0)), x0=number("x_0"), y0=number("y_0"), to_metre=to_metre)
    if kind in ("longlat", "latlong"):
        return Projection("longlat", a, rf)
    raise ValueError(f"projection {kind or text!r} is not supported")
