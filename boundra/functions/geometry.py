"""Geometry as column expressions: struct<kind, parts: polygons -> rings -> positions {x, y}>.

Lines use one ring for each part, points one position. Everything here stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOM_TYPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def position(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def positions(geom: Column) -> Column:
    return F.flatten(rings(geom))


def edges(geom: Column) -> Column:
    """Segments of all rings or lines: array<struct<ax, ay, bx, by>>."""

    def of_ring(ring: Column) -> Column:
        return F.zip_with(
            F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
            F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
            lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
        )

    return F.flatten(F.transform(rings(geom), of_ring))


def turn(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of the triangle a, b, p."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def on_segment(e: Column, x: Column, y: Column) -> Column:
    return (
        (turn(e["ax"], e["ay"], e["bx"], e["by"], x, y) == 0)
        & (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"]))
        & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"]))
    )


def point_covered(x: Column, y: Column, segments: Column) -> Column:
    """Whether a polygon with these edges covers the point; its boundary, also of holes, belongs to it."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (  # noqa: E731 the edge lies right of the point at its height
        F.when(e["by"] > e["ay"], turn(e["ax"], e["ay"], e["bx"], e["by"], x, y) > 0).otherwise(turn(e["ax"], e["ay"], e["bx"], e["by"], x, y) < 0)
    )
    odd = F.size(F.filter(segments, crosses)) % 2 == 1
    return odd | F.exists(segments, lambda e: on_segment(e, x, y))


def segments_meet(e: Column, f: Column) -> Column:
    """Whether two segments share a point."""
    d1 = F.signum(turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]))
    d2 = F.signum(turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"]))
    d3 = F.signum(turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]))
    d4 = F.signum(turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"]))
    boxes = (
        (F.least(e["ax"], e["bx"]) <= F.greatest(f["ax"], f["bx"])) & (F.least(f["ax"], f["bx"]) <= F.greatest(e["ax"], e["bx"]))
        & (F.least(e["ay"], e["by"]) <= F.greatest(f["ay"], f["by"])) & (F.least(f["ay"], f["by"]) <= F.greatest(e["ay"], e["by"]))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def outline(geom: Column) -> Column:
    """What relations need of a geometry, computed once for each: struct<area, segments, firsts>; firsts has a position of each part."""
    return F.struct(geom["kind"].isin("Polygon", "MultiPolygon").alias("area"), edges(geom).alias("segments"), F.transform(geom["parts"], lambda p: F.get(F.get(p, 0), 0)).alias("firsts"))


def outlines_meet(a: Column, b: Column, box: Column) -> Column:
    """Whether two outlines share a point; ``box`` (min_x, min_y, max_x, max_y) holds all that they can share.

    Only segments that touch the box are compared with each other.
    """
    touching = lambda segments: F.filter(
        segments,
        lambda e: (F.least(e["ax"], e["bx"]) <= box["max_x"]) & (F.greatest(e["ax"], e["bx"]) >= box["min_x"]) & (F.least(e["ay"], e["by"]) <= box["max_y"]) & (F.greatest(e["ay"], e["by"]) >= box["min_y"]),
    )
    crossing = let(touching(b["segments"]), lambda near: F.exists(touching(a["segments"]), lambda e: F.exists(near, lambda f: segments_meet(e, f))))
    inside = lambda inner, outer: outer["area"] & F.exists(inner["firsts"], lambda p: point_covered(p["x"], p["y"], outer["segments"]))
    return crossing | inside(a, b) | inside(b, a)


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons or lines share a point; touching counts."""
    everywhere = F.struct(*[F.lit(v).alias(n) for n, v in (("min_x", float("-inf")), ("min_y", float("-inf")), ("max_x", float("inf")), ("max_y", float("inf")))])
    return outlines_meet(outline(a), outline(b), everywhere)


def bbox(geom: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y>; null for an empty geometry."""
    xs, ys = F.transform(positions(geom), lambda p: p["x"]), F.transform(positions(geom), lambda p: p["y"])
    return F.when(F.size(xs) > 0, F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))


def vertex_count(geom: Column) -> Column:
    return F.aggregate(rings(geom), F.lit(0), lambda n, r: n + F.size(r))


def _ring_moments(ring: Column) -> Column:
    """Signed double area and its first moments: struct<w, mx, my>."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def add(s: Column, e: Column) -> Column:
        c = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct((s["w"] + c).alias("w"), (s["mx"] + c * (e["ax"] + e["bx"]) / 3).alias("mx"), (s["my"] + c * (e["ay"] + e["by"]) / 3).alias("my"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    # the sign of the area says how the ring turns; moments are taken per unit of area
    return F.aggregate(sides, zero, add)


def centroid(geom: Column) -> Column:
    """Polygons by area less their holes, lines by length, points by mean; the mean where that weighs nothing."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    plus = lambda s, t: F.struct((s["w"] + t["w"]).alias("w"), (s["mx"] + t["mx"]).alias("mx"), (s["my"] + t["my"]).alias("my"))

    def turned(m: Column, sign: int) -> Column:
        k = F.when(m["w"] < 0, F.lit(-1.0 * sign)).otherwise(F.lit(1.0 * sign))
        return F.struct((m["w"] * k).alias("w"), (m["mx"] * k).alias("mx"), (m["my"] * k).alias("my"))

    def polygon(p: Column) -> Column:
        # the outer ring adds, the holes take away, whichever way they turn
        moments = F.transform(p, lambda r, k: F.struct(k.alias("k"), _ring_moments(r).alias("m")))
        return F.aggregate(moments, zero, lambda s, x: plus(s, F.when(x["k"] == 0, turned(x["m"], 1)).otherwise(turned(x["m"], -1))))

    by_area = F.aggregate(F.transform(geom["parts"], polygon), zero, plus)

    def side(s: Column, e: Column) -> Column:
        n = F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
        return F.struct((s["w"] + n).alias("w"), (s["mx"] + n * (e["ax"] + e["bx"]) / 2).alias("mx"), (s["my"] + n * (e["ay"] + e["by"]) / 2).alias("my"))

    by_length = F.aggregate(edges(geom), zero, side)
    by_mean = F.aggregate(positions(geom), zero, lambda s, p: F.struct((s["w"] + 1).alias("w"), (s["mx"] + p["x"]).alias("mx"), (s["my"] + p["y"]).alias("my")))
    weighted = F.when(geom["kind"].isin("Polygon", "MultiPolygon"), by_area).when(geom["kind"].isin("LineString", "MultiLineString"), by_length).otherwise(by_mean)
    mean = lambda m: F.struct((m["mx"] / m["w"]).alias("x"), (m["my"] / m["w"]).alias("y"))
    return F.when(F.size(positions(geom)) > 0, let(weighted, lambda m: F.when(m["w"] != 0, mean(m)).otherwise(let(by_mean, mean))))


def validate_geometry(geom: Column) -> Column:
    """The first thing wrong with a geometry, or null."""
    finite = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    kinds = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    closed = lambda r: (F.get(r, 0)["x"] == F.element_at(r, -1)["x"]) & (F.get(r, 0)["y"] == F.element_at(r, -1)["y"])
    return (
        F.when(geom.isNull() | geom["kind"].isNull() | ~geom["kind"].isin(*kinds), "UNKNOWN_KIND")
        .when(F.coalesce(F.size(geom["parts"]), F.lit(0)) <= 0, "EMPTY")
        .when(F.exists(geom["parts"], lambda p: F.coalesce(F.size(p), F.lit(0)) <= 0) | F.exists(rings(geom), lambda r: F.coalesce(F.size(r), F.lit(0)) <= 0), "EMPTY")
        .when(~F.forall(positions(geom), finite), "NOT_FINITE")
        .when(geom["kind"].isin("LineString", "MultiLineString") & F.exists(rings(geom), lambda r: F.size(r) < 2), "LINE_TOO_SHORT")
        .when(geom["kind"].isin("Polygon", "MultiPolygon") & F.exists(rings(geom), lambda r: F.size(r) < 4), "RING_TOO_SHORT")
        .when(geom["kind"].isin("Polygon", "MultiPolygon") & F.exists(rings(geom), lambda r: ~closed(r)), "RING_NOT_CLOSED")
    )
