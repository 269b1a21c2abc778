"""Areas cut into the cells of a grid, so that no area is one key and no point meets a whole outline.

A cell holds only the segments that touch it, in chunks of a bounded number, and whether its reference point lies inside;
a cell without segments lies wholly inside or outside. A point is inside if the line from it to the reference point of
its cell crosses an odd number of segments and that one is outside, or an even number and that one is inside. So an
answer takes one equi-join on cells, and chunks add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundra.functions.geometry import edges, on_segment, segments_meet, turn, vertex_count

KEY = ("layer_id", "object_id", "snapshot_id")
#: Cells on a side at most, and segments of one chunk at most. Neighbours along an outline share a chunk.
SIDE, CHUNK = 1024, 1024
#: Segments of a run.
RUN = 64
#: Where a cell's reference point lies in it: fractions that coordinates in decimals don't meet.
_RIGHT, _UP = 0.6180339887498949, 0.41421356237309503
#: Up to so many tiles, counted with 32 for each chunk of segments, are sent to all tasks; more are joined by shuffling.
SENT_TILES = 400_000


def _cell(v: Column) -> Column:
    return F.floor(v / F.col("_s")).cast("bigint")


def _side(area_box: dict[str, Column]) -> Column:
    return F.greatest(area_box["max_x"] - area_box["min_x"], area_box["max_y"] - area_box["min_y"], F.lit(1e-6))


def tile_levels(areas: DataFrame) -> DataFrame:
    """``areas`` with ``level``: cells are 2**level wide, about as many as an area has segments, and not much finer than these are long."""
    n = F.greatest(vertex_count(F.col("geom")), F.lit(4)).cast("double")
    box = {c: F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")}
    length = F.aggregate(edges(F.col("geom")), F.lit(0.0), lambda s, e: s + F.abs(e["ax"] - e["bx"]) + F.abs(e["ay"] - e["by"]))
    width = F.greatest(_side(box) / F.least(F.sqrt(n), F.lit(float(SIDE))), length / n / 8, F.lit(1e-6))
    return areas.withColumn("level", F.ceil(F.log2(width)).cast("int"))


def _segments(held: DataFrame) -> DataFrame:
    """A row for each segment, with its number: key, level, _s, n, e."""
    return held.select(*KEY, "level", F.pow(F.lit(2.0), F.col("level")).alias("_s"), F.posexplode(edges(F.col("geom"))).alias("n", "e"))


def _touched(segments: DataFrame, bounded: bool = False) -> DataFrame:
    """Cells that a segment touches, row by row of the grid; some it only passes by. If ``bounded``, those of a box (_x, _y, _to_x, _to_y)."""
    e = F.col("e")
    low, high = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
    if bounded:
        low, high = F.greatest(low, F.col("_y")), F.least(high, F.col("_to_y"))
        segments = segments.filter(low <= high)
    rows = segments.withColumn("cy", F.explode(F.sequence(_cell(low), _cell(high))))
    flat = e["ay"] == e["by"]
    at = lambda y: e["ax"] + (e["bx"] - e["ax"]) * ((y - e["ay"]) / F.when(flat, F.lit(1.0)).otherwise(e["by"] - e["ay"]))
    x1, x2 = at(F.greatest(low, F.col("cy") * F.col("_s"))), at(F.least(high, (F.col("cy") + 1) * F.col("_s")))
    x1, x2 = F.when(flat, e["ax"]).otherwise(x1), F.when(flat, e["bx"]).otherwise(x2)
    slack = F.col("_s") * 1e-9  # for rounding; a cell too many does no harm
    left = F.greatest(F.least(x1, x2) - slack, F.least(e["ax"], e["bx"]))
    right = F.least(F.greatest(x1, x2) + slack, F.greatest(e["ax"], e["bx"]))
    left, right = F.least(left, right), F.greatest(left, right)
    if bounded:
        left, right = F.greatest(left, F.col("_x")), F.least(right, F.col("_to_x"))
        return rows.filter(left <= right).withColumn("cx", F.explode(F.sequence(_cell(left), _cell(right))))
    return rows.withColumn("cx", F.explode(F.sequence(_cell(left), _cell(right))))


def _reference(cx: Column, cy: Column) -> tuple[Column, Column]:
    return (cx + _RIGHT) * F.col("_s"), (cy + _UP) * F.col("_s")


def _crossings(segments: DataFrame) -> DataFrame:
    """For each row of cells and segment that crosses its line of reference points: the first cell whose point lies right of it."""
    e = F.col("e")
    first = F.ceil(F.least(e["ay"], e["by"]) / F.col("_s") - _UP - 1e-9).cast("bigint")
    last = F.floor(F.greatest(e["ay"], e["by"]) / F.col("_s") - _UP + 1e-9).cast("bigint")
    rows = segments.filter(first <= last).withColumn("cy", F.explode(F.sequence(first, last)))
    y = _reference(F.lit(0), F.col("cy"))[1]
    rows = rows.filter((e["ay"] > y) != (e["by"] > y))
    x = e["ax"] + (e["bx"] - e["ax"]) * ((y - e["ay"]) / (e["by"] - e["ay"]))
    near = F.floor(x / F.col("_s") - _RIGHT).cast("bigint")

    def right_of(cx: Column) -> Column:
        side = turn(e["ax"], e["ay"], e["bx"], e["by"], *_reference(cx, F.col("cy")))
        return F.when(e["by"] > e["ay"], side < 0).otherwise(side > 0)

    cx = F.when(right_of(F.col("_near")), F.col("_near")).when(right_of(F.col("_near") + 1), F.col("_near") + 1).otherwise(F.col("_near") + 2)
    return rows.withColumn("_near", near).select(*KEY, "cy", cx.alias("cx"))


def tile_areas(areas: DataFrame) -> DataFrame:
    """Tiles of polygons: key, level, cx, cy, inside (of the reference point), chunk, segments (null where none touch the cell).

    All cells of an area's box are there, also those outside, so that a point meets each area whose box holds
    its cell. Areas need layer_id, object_id, snapshot_id, geom and their box; what isn't a polygon has no tiles.
    Nothing is gathered by area: segments are grouped by cell and ``CHUNK`` neighbours, crossings by row of cells.
    """
    held = tile_levels(areas.filter(F.col("geom.kind").isin("Polygon", "MultiPolygon")))
    segments = _segments(held)
    local = _touched(segments).groupBy(*KEY, "cx", "cy", F.floor(F.col("n") / CHUNK).cast("int").alias("chunk")).agg(F.collect_list("e").alias("segments"))
    boxes = held.select(*KEY, "level", *(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))).withColumn("_s", F.pow(F.lit(2.0), F.col("level")))
    rows = boxes.select(*KEY, "level", "_s", _cell(F.col("min_x")).alias("_from"), _cell(F.col("max_x")).alias("_to"), F.explode(F.sequence(_cell(F.col("min_y")), _cell(F.col("max_y")))).alias("cy"))
    steps = _crossings(segments).groupBy(*KEY, "cy", "cx").count()
    row_key = [*KEY, "cy"]
    steps = steps.join(rows, row_key).unionByName(rows.withColumns({"cx": F.col("_from"), "count": F.lit(0).cast("bigint")})).groupBy(*row_key, "level", "_to", "cx").agg(F.sum("count").alias("count"))
    along = Window.partitionBy(*row_key).orderBy("cx")
    steps = steps.withColumn("inside", F.sum("count").over(along) % 2 == 1).withColumn("_next", F.lead("cx").over(along))
    upto = F.coalesce(F.col("_next") - 1, F.col("_to"))
    cells = steps.filter(F.col("cx") <= upto).select(*KEY, "level", "cy", "inside", F.explode(F.sequence(F.col("cx"), upto)).alias("cx"))
    tiled = cells.join(local, [*KEY, "cx", "cy"], "left")
    return tiled.select(*KEY, "level", "cx", "cy", "inside", "chunk", "segments")


def sent(tiles: DataFrame) -> DataFrame:
    """Tiles, best written ones, with a broadcast hint if they were counted to be few."""
    size = tiles.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("segments"), F.lit(0))).alias("s")).first()
    return F.broadcast(tiles) if size.n + (size.s or 0) // 4 <= SENT_TILES else tiles


def _levels(tiles: DataFrame) -> list[int]:
    """Levels in use: sizes double from one to the next, so there are few."""
    return sorted(r.level for r in tiles.select("level").distinct().collect())


def _crossed(px: Column, py: Column) -> dict[str, Column]:
    """Of the tile columns: how many segments part a point from the reference point, and whether it lies on one."""
    to_x, to_y = F.col("_to_x"), F.col("_to_y")
    crosses = lambda e: ((turn(px, py, to_x, to_y, e["ax"], e["ay"]) > 0) != (turn(px, py, to_x, to_y, e["bx"], e["by"]) > 0)) & (
        (turn(e["ax"], e["ay"], e["bx"], e["by"], px, py) > 0) != (turn(e["ax"], e["ay"], e["bx"], e["by"], to_x, to_y) > 0)
    )
    return {"_n": F.coalesce(F.size(F.filter("segments", crosses)), F.lit(0)), "_on": F.coalesce(F.exists("segments", lambda e: on_segment(e, px, py)), F.lit(False))}


def _met(points: DataFrame, tiles: DataFrame, on: list[str]) -> DataFrame:
    """Points with their cells (level, cx, cy, _s) and the tiles there."""
    to_x, to_y = _reference(F.col("cx"), F.col("cy"))
    return points.join(tiles, [*on, "level", "cx", "cy"]).withColumns({"_to_x": to_x, "_to_y": to_y}).withColumns(_crossed(F.col("_x"), F.col("_y"))).drop("segments", "_to_x", "_to_y", "chunk")


#: What chunks of a tile say together.
_COVERED = "max(_on) OR (sum(_n) + max(cast(inside AS INT))) % 2 = 1"


def points_in_tiles(points: DataFrame, tiles: DataFrame, more: DataFrame | None = None, on: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (columns of ``points``, among them x and y, all of which tell a point apart) and areas whose cells hold them: key, covered.

    ``more`` has further columns of the areas by key, ``on`` is a condition on both sides' columns, and columns of
    ``more`` named in ``keep`` are given. The border of an area, also of its holes, belongs to it.
    """
    own = points.columns
    levels = F.array(*[F.lit(v) for v in _levels(tiles)]).cast("array<int>")
    spread = points.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double"), "level": F.explode(levels)})
    spread = spread.withColumn("_s", F.pow(F.lit(2.0), F.col("level"))).withColumns({"cx": _cell(F.col("_x")), "cy": _cell(F.col("_y"))})
    met = _met(spread, sent(tiles), [])
    if more is not None:
        met = met.join(more, list(KEY))
        met = met if on is None else met.filter(on)
    return met.groupBy(*own, *KEY).agg(F.expr(_COVERED).alias("covered"), *(F.first(c).alias(c) for c in keep))


def positions_in_tiles(positions: DataFrame, tiles: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (pair columns, among them those of ``by``, which are the tiles' key; x, y, level of the tiles): pairs of which a position is covered."""
    pair = [c for c in positions.columns if c not in ("x", "y", "level")]
    cells = positions.withColumns({"_x": F.col("x"), "_y": F.col("y"), "_s": F.pow(F.lit(2.0), F.col("level"))}).withColumns({"cx": _cell(F.col("x")), "cy": _cell(F.col("y"))})
    return _met(cells, tiles, by).groupBy(*pair, "x", "y").agg(F.expr(_COVERED).alias("covered")).filter("covered").select(*pair).distinct()


def runs_of(held: DataFrame, by: list[str]) -> DataFrame:
    """Segments of geometries of any kind in runs of ``RUN`` neighbours: ``by``, segments, and the run's box."""
    runs = held.select(*by, F.posexplode(edges(F.col("geom"))).alias("n", "e")).groupBy(*by, F.floor(F.col("n") / RUN).alias("run")).agg(
        F.collect_list("e").alias("segments"), F.min(F.least("e.ax", "e.bx")).alias("_x1"), F.min(F.least("e.ay", "e.by")).alias("_y1"), F.max(F.greatest("e.ax", "e.bx")).alias("_x2"), F.max(F.greatest("e.ay", "e.by")).alias("_y2")
    )
    return runs.drop("run")


def cells_of(held: DataFrame, by: list[str]) -> DataFrame:
    """Segments of geometries of any kind by cell: ``by``, cx, cy, segments. ``held`` needs geom and level."""
    segments = held.select(*by, "level", F.pow(F.lit(2.0), F.col("level")).alias("_s"), F.posexplode(edges(F.col("geom"))).alias("n", "e"))
    return _touched(segments).groupBy(*by, "cx", "cy", F.floor(F.col("n") / CHUNK).alias("chunk")).agg(F.collect_list("e").alias("segments")).drop("chunk")


def crossing_pairs(pairs: DataFrame, runs: DataFrame, cells: DataFrame, runs_by: list[str], cells_by: list[str]) -> DataFrame:
    """Pairs of geometries, segments of which share a point.

    ``pairs`` has both keys, the box both share (_x, _y, _to_x, _to_y) and ``level``, that of ``cells``. Segments of
    one side, best that of fewer, are laid on the other side's cells inside the shared box, and meet what these hold.
    """
    pair = [*runs_by, *cells_by]
    near = pairs.join(runs, runs_by).filter((F.col("_x1") <= F.col("_to_x")) & (F.col("_x2") >= F.col("_x")) & (F.col("_y1") <= F.col("_to_y")) & (F.col("_y2") >= F.col("_y")))
    each = near.select(*pair, F.pow(F.lit(2.0), F.col("level")).alias("_s"), "_x", "_y", "_to_x", "_to_y", F.explode("segments").alias("e"))
    laid = _touched(each, bounded=True).select(*pair, "cx", "cy", "e").groupBy(*pair, "cx", "cy").agg(F.collect_list("e").alias("ours"))
    return laid.join(cells, [*cells_by, "cx", "cy"]).filter(segments_cross(F.col("ours"), F.col("segments"))).select(*pair).distinct()


def segments_cross(a: Column, b: Column) -> Column:
    return F.exists(a, lambda e: F.exists(b, lambda f: segments_meet(e, f)))
