"""Areas in tiles against the plain predicates, and how evenly the work is dealt."""

import math
import random

import pytest
from pyspark.sql import functions as F

from boundra.functions.geometry import GEOM_TYPE, bbox, edges, intersects, point_covered
from boundra.operators import tiles as tiles_of
from boundra.operators.spatial import locate_points, relate_areas
from boundra.operators.tiles import KEY, points_in_tiles, tile_areas
from boundra.sources.storage import written


def ring(r, cx, cy, radius, n, turn=1):
    out = [(float(round(cx + radius * q * math.cos(t))), float(round(cy + radius * q * math.sin(t)))) for t, q in ((turn * 2 * math.pi * k / n, 0.4 + 0.6 * r.random()) for k in range(n))]
    return [*out, out[0]]


def shapes(seed, n):
    """Rings of few and of many segments, with holes, further parts, and squares on the grid's own lines; lines too."""
    r, out = random.Random(seed), []
    for i in range(n):
        cx, cy, radius, k = r.randint(-300, 300), r.randint(-300, 300), r.choice([5, 50, 400]), r.choice([3, 4, 7, 40, 300])
        parts = [[ring(r, cx, cy, radius, k)]]
        if i % 2:
            parts[0].append(ring(r, cx, cy, radius / 4, 5, -1))
        if i % 5 == 0:
            parts.append([ring(r, cx + 2 * radius, cy, radius, 6)])
        if i % 7 == 0:
            parts = [[[(cx + dx, cy + dy) for dx, dy in ((0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0), (0.0, 0.0))]]]
        kind = "MultiPolygon" if len(parts) > 1 else "Polygon"
        if i % 9 == 8:
            kind, parts = "LineString", [[parts[0][0][:-1]]]
        out.append(("L", str(i), 1, f"n{i % 6}", (kind, parts)))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, f"layer_id string, object_id string, snapshot_id long, name string, geom {GEOM_TYPE}")
    return written(df.withColumn("_b", bbox(F.col("geom"))).select("*", "_b.*").drop("_b"), "shapes")


@pytest.mark.parametrize("chunk, sent", [(1024, 400_000), (3, 0)])
def test_points_in_tiles_by_brute_force(spark, monkeypatch, chunk, sent):
    """Corners, points on borders and in holes; also with cells of many chunks, and without broadcasts."""
    monkeypatch.setattr(tiles_of, "CHUNK", chunk)
    monkeypatch.setattr(tiles_of, "SENT_TILES", sent)
    rows, r = shapes(1, 40), random.Random(2)
    at = [(float(r.randint(-500, 500)), float(r.randint(-500, 500))) for _ in range(1500)]
    for *_, (_, parts) in rows:
        for p in parts:
            for g in p:
                at += g[:6] + [((g[0][0] + g[1][0]) / 2, (g[0][1] + g[1][1]) / 2)]
    points = written(spark.createDataFrame([(k, *xy) for k, xy in enumerate(at)], "point_id long, x double, y double"), "points")
    areas = table(spark, rows)
    found = {(x.point_id, x.object_id) for x in points_in_tiles(points, written(tile_areas(areas), "tiles")).filter("covered").collect()}
    plain = areas.filter("geom.kind <> 'LineString'").select("object_id", "min_x", "max_x", "min_y", "max_y", edges(F.col("geom")).alias("e"))
    box = (F.col("x") >= F.col("min_x")) & (F.col("x") <= F.col("max_x")) & (F.col("y") >= F.col("min_y")) & (F.col("y") <= F.col("max_y"))
    wanted = {(x.point_id, x.object_id) for x in points.join(plain, box).filter(point_covered(F.col("x"), F.col("y"), F.col("e"))).select("point_id", "object_id").collect()}
    assert found == wanted and len(wanted) > 1000
    # candidates are areas whose box holds the point, and the ceiling holds for them
    counts = {x.point_id: x["count"] for x in points.join(plain, box).groupBy("point_id").count().collect()}
    refused = {x.point_id for x in locate_points(points, areas, limit=100, max_candidates=4).filter("status <> 'OK'").collect()}
    assert refused == {p for p, n in counts.items() if n > 4}


def star(n, points=5, radius=1_000_000.0):
    """The border of a star of ``n`` segments with small waves."""
    corners = [(radius * (1.0 if k % 2 == 0 else 0.4) * math.cos(math.pi * k / points), radius * (1.0 if k % 2 == 0 else 0.4) * math.sin(math.pi * k / points)) for k in range(2 * points)]
    out, each = [], n // (2 * points)
    for k in range(2 * points):
        (ax, ay), (bx, by) = corners[k], corners[(k + 1) % (2 * points)]
        out += [(ax + (bx - ax) * i / each + (i % 3) * 0.7, ay + (by - ay) * i / each - (i % 2) * 0.9) for i in range(each)]
    return [*out, out[0]]


def test_an_area_of_very_many_segments_is_no_key(spark):
    """200 000 segments, a hole, points everywhere and on the border; no tile, and no task, holds much of it."""
    outer = star(200_000)
    hole = [(x / 4, y / 4) for x, y in star(2000)]
    areas = table(spark, [("L", "star", 1, "star", ("Polygon", [[outer, hole]]))])
    tiles = written(tile_areas(areas), "tiles")
    sizes = tiles.groupBy(*KEY, "cx", "cy").agg(F.sum(F.coalesce(F.size("segments"), F.lit(0))).alias("n"))
    most = sizes.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    assert most.n < 600 and most.cells > 40_000
    by_task = [x["count"] for x in tiles.repartition(16, "level", "cx", "cy").groupBy(F.spark_partition_id()).count().collect()]
    assert max(by_task) <= 4 * sorted(by_task)[len(by_task) // 2]
    r = random.Random(3)
    at = [(r.uniform(-1e6, 1e6), r.uniform(-1e6, 1e6)) for _ in range(4000)] + outer[:50] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(hole[:50], hole[1:])]
    points = spark.createDataFrame([(k, *xy) for k, xy in enumerate(at)], "point_id long, x double, y double")
    found = {x.point_id for x in points_in_tiles(points, tiles).filter("covered").collect()}

    def inside(x, y):
        odd = False
        for g in (outer, hole):
            for (ax, ay), (bx, by) in zip(g, g[1:]):
                if (ay > y) != (by > y) and ((bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0) == (by > ay):
                    odd = not odd
        return odd

    some = list(range(0, 4000, 100))
    assert [k in found for k in some] == [inside(*at[k]) for k in some]
    assert all(4000 + k in found for k in range(50))


@pytest.mark.parametrize("limit", [2, 100])
def test_relations_by_brute_force(spark, monkeypatch, limit):
    rows = shapes(4, 45)
    areas = table(spark, rows)
    found = relate_areas(areas, areas, limit=limit, tested=True).collect()
    a, b = areas.alias("a"), areas.alias("b")
    met = a.join(b, F.col("a.object_id") != F.col("b.object_id")).filter(intersects(F.col("a.geom"), F.col("b.geom"))).select(F.col("a.object_id").alias("s"), F.col("b.object_id").alias("t"), F.col("b.name").alias("n"))
    wanted = {}
    for x in met.collect():
        wanted.setdefault(x.s, []).append((x.n, x.t))
    assert {(x.source_id, x.rank, x.object_id) for x in found} == {(s, i, t) for s, ts in wanted.items() for i, (_, t) in enumerate(sorted(ts)[:limit], 1)}
    tests = {x.source_id: x.tested for x in found}
    assert all(0 < n < len(rows) for n in tests.values())
    if limit == 2:  # the first batch has four candidates
        assert any(n == 4 for n in tests.values())


def test_no_more_candidates_than_a_batch_takes(spark, monkeypatch):
    """200 areas that all overlap: sources meet the first of them in order only, and rows with ceilings know that there are more."""
    from boundra.operators import spatial
    from boundra.plans.fixtures import with_box

    square = "named_struct('kind', 'Polygon', 'parts', array(array(transform(array(0, 9, 9, 0, 0), (v, i) -> named_struct('x', cast(v AS double) + id / 100, 'y', cast(element_at(array(0, 0, 9, 9, 0), i + 1) AS double))))))"
    areas = with_box(spark.range(200).selectExpr("'L' AS layer_id", "lpad(id, 3, '0') AS object_id", "'n' AS name", "1L AS snapshot_id", f"{square} AS geom"))
    met, plain = [], spatial.bbox_candidates

    def counted(left, right, *more):
        met.append((left.count(), right.count()))
        return plain(left, right, *more)

    monkeypatch.setattr(spatial, "bbox_candidates", counted)
    found = spatial.relate_areas(areas, areas, limit=2, tested=True).collect()
    assert len(found) == 400 and {x.object_id for x in found} == {"000", "001", "002"} and {x.tested for x in found} == {4}
    assert sum(a * b for a, b in met) < 200 * 200 / 8
    assert {(x.status, x.object_id) for x in spatial.relate_areas(areas, areas, limit=2, max_candidates=198).collect()} == {("COST_LIMIT_EXCEEDED", None)}
    assert all(x.status == "OK" for x in spatial.relate_areas(areas, areas, limit=2, max_candidates=199).collect())
