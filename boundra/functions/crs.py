"""EPSG:4326 <-> EPSG:2180 as column expressions: Krueger's series for the transverse Mercator projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of EPSG:2180 on GRS80
CENTRAL, SCALE, EAST, NORTH = 19.0, 0.9993, 500000.0, -5300000.0
A_AXIS, FLATTENING = 6378137.0, 1 / 298.257222101


def series() -> tuple[float, list[float], list[float], float]:
    """Rectifying radius, forward and inverse coefficients by the third flattening, and the eccentricity."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
    ]
    return radius, alpha, beta, 2 * math.sqrt(n) / (1 + n)


def to_2180(lon: Column, lat: Column) -> Column:
    """struct<x, y> in metres; null outside the degrees' range or where not finite."""
    radius, alpha, _, e = series()
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x, y = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta), y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    good = lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.when(good, F.struct((EAST + SCALE * radius * x).alias("x"), (NORTH + SCALE * radius * y).alias("y")))


def _plain(value: Column, then) -> Column:
    return then(value)


def to_4326(x: Column, y: Column, hold=_plain) -> Column:
    """struct<lon, lat> in degrees; null where not finite or outside the degrees' range.

    ``hold`` gives a value to what uses it several times. Spark finds such values by itself, but not inside lambdas: there it is ``let``.
    """
    radius, _, beta, e = series()
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def conformal(at: Column) -> Column:
        xi, eta = at["a"], at["b"]
        for k, b in enumerate(beta, 1):
            xi, eta = xi - b * F.sin(2 * k * at["a"]) * F.cosh(2 * k * at["b"]), eta - b * F.cos(2 * k * at["a"]) * F.sinh(2 * k * at["b"])
        return hold(pair(xi, eta), sphere)

    def sphere(at: Column) -> Column:
        lon = CENTRAL + F.degrees(F.atan2(F.sinh(at["b"]), F.cos(at["a"])))
        return hold(F.sin(F.asin(F.sin(at["a"]) / F.cosh(at["b"]))), lambda s: hold(pair(s, F.atanh(s)), lambda v: hold(pair(lon, latitude(v)), checked)))

    def latitude(v: Column) -> Column:
        # the isometric latitude is undone by a fixed number of steps, each gaining more than two digits
        s = v["a"]
        for _ in range(7):
            s = F.tanh(v["b"] + e * F.atanh(e * s))
        return F.degrees(F.asin(s))

    def checked(at: Column) -> Column:
        good = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < 1e9) & (F.abs(y) < 1e9)
        return F.when(good & at["a"].between(-180, 180) & at["b"].between(-90, 90), F.struct(at["a"].alias("lon"), at["b"].alias("lat")))

    return hold(pair((y - NORTH) / (SCALE * radius), (x - EAST) / (SCALE * radius)), conformal)


def map_positions(geom: Column, change) -> Column:
    """Apply a function of x and y giving struct<x, y> to every position."""
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda q: change(q["x"], q["y"])))).alias("parts"))
