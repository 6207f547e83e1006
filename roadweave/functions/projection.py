"""Longitude and latitude to UTM metres and back, as plain column expressions (Krüger's series to the sixth order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import wrap
from .geometry import once

# The WGS84 ellipsoid and the UTM grid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Coefficients of n, n^2, ... in the forward and the inverse series.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)


def _series(table: tuple[tuple[float, ...], ...]) -> list[float]:
    """Values of the coefficients for this ellipsoid; row j starts at the j-th power of n."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


def utm_zone(lon: Column) -> Column:
    """1 to 60."""
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm_code(lon: Column, lat: Column) -> Column:
    """Name of the zone's coordinate system, as EPSG:326zz in the north and EPSG:327zz in the south."""
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("string"))


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in a zone."""
    phi = F.radians(lat)
    lam = F.radians(lon - float(6 * zone - 183))
    tau = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi = F.atan2(tau, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(tau * tau + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(_series(FORWARD), 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * east, (NORTHING_SOUTH if south else 0.0) + SCALE * _RADIUS * north


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a zone."""
    xi = (y - (NORTHING_SOUTH if south else 0.0)) / (SCALE * _RADIUS)
    eta = (x - EASTING) / (SCALE * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_series(INVERSE), 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for _ in range(5):  # from conformal to geographic latitude
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + _E * F.atanh(_E * F.sin(phi))))
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + float(6 * zone - 183), F.degrees(phi)


def _inverse(lon0: Column, lat0: Column, lon1: Column, lat1: Column, rounds: int) -> Column:
    """Vincenty's inverse problem after a fixed number of rounds, as a struct: l is the longitudes' gap on the sphere, moved what
    the last round changed of it; s1, c1, s2, c2 are the sines and cosines of the reduced latitudes."""
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    angles = F.struct(reduced(lat0).alias("u1"), reduced(lat1).alias("u2"), F.radians(lon1 - lon0).alias("gap"))
    sides = lambda v: F.struct(F.sin(v["u1"]).alias("s1"), F.cos(v["u1"]).alias("c1"), F.sin(v["u2"]).alias("s2"), F.cos(v["u2"]).alias("c2"), v["gap"].alias("gap"))

    def solve(e: Column) -> Column:
        s1, c1, s2, c2, gap = (e[n] for n in ("s1", "c1", "s2", "c2", "gap"))
        start = F.struct(gap.alias("l"), *[F.lit(0.0).alias(n) for n in ("ss", "cs", "ca", "cm", "moved")])

        def better(s: Column, _: Column) -> Column:
            """Each step goes into a struct, so that what builds on it doesn't work it out again."""
            lam = s["l"]
            turned = F.struct(F.sin(lam).alias("sl"), F.cos(lam).alias("cl"))
            arc = lambda v: F.struct(
                v["sl"].alias("sl"), F.sqrt(F.pow(c2 * v["sl"], F.lit(2)) + F.pow(c1 * s2 - s1 * c2 * v["cl"], F.lit(2))).alias("ss"), (s1 * s2 + c1 * c2 * v["cl"]).alias("cs"),
            )
            slope = lambda v: F.struct(v["ss"].alias("ss"), v["cs"].alias("cs"), F.when(v["ss"] > 0, c1 * c2 * v["sl"] / v["ss"]).otherwise(0.0).alias("sa"))
            square = lambda v: F.struct(v["ss"].alias("ss"), v["cs"].alias("cs"), v["sa"].alias("sa"), (1 - v["sa"] * v["sa"]).alias("ca"))
            middle = lambda v: F.struct(
                *[v[n].alias(n) for n in ("ss", "cs", "sa", "ca")], F.when(v["ca"] > 0, v["cs"] - 2 * s1 * s2 / v["ca"]).otherwise(0.0).alias("cm"),
                (FLATTENING / 16 * v["ca"] * (4 + FLATTENING * (4 - 3 * v["ca"]))).alias("c"),
            )

            def moved(v: Column) -> Column:
                ss, cs, cm, c = v["ss"], v["cs"], v["cm"], v["c"]
                far = gap + (1 - c) * FLATTENING * v["sa"] * (F.atan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
                return once(far, lambda l: F.struct(l.alias("l"), ss.alias("ss"), cs.alias("cs"), v["ca"].alias("ca"), cm.alias("cm"), F.abs(l - lam).alias("moved")))

            value = turned
            for step in (arc, slope, square, middle, moved):
                value = once(value, step)
            return value

        last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, better)
        return once(last, lambda s: F.struct(*[s[n].alias(n) for n in ("l", "ss", "cs", "ca", "cm", "moved")], *[e[n].alias(n) for n in ("s1", "c1", "s2", "c2")]))

    return once(once(angles, sides), solve)


def geodesic_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column, rounds: int = 8) -> Column:
    """Ellipsoidal distance by Vincenty's inverse formula, with a fixed number of rounds (not for antipodes)."""
    b = AXIS * (1 - FLATTENING)

    def length(s: Column) -> Column:
        u = s["ca"] * (AXIS * AXIS - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        cm, cs, ss = s["cm"], s["cs"], s["ss"]
        delta = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return b * big * (F.atan2(ss, cs) - delta)

    return once(_inverse(lon0, lat0, lon1, lat1, rounds), length)


def geodesic_bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column, rounds: int = 8) -> Column:
    """Direction on the ellipsoid from the first place to the second, in radians from east anticlockwise, from -pi up to pi.

    0 for one and the same place; null where the rounds don't settle, as for places that are nearly antipodal.
    """

    def settled(s: Column) -> Column:
        sl, cl = F.sin(s["l"]), F.cos(s["l"])
        azimuth = F.atan2(s["c2"] * sl, s["c1"] * s["s2"] - s["s1"] * s["c2"] * cl)
        return F.when(s["moved"] < 1e-9, wrap(F.pi() / 2 - azimuth))

    return F.when((lon0 == lon1) & (lat0 == lat1), 0.0).otherwise(once(_inverse(lon0, lat0, lon1, lat1, rounds), settled))
