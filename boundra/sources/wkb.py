"""WKB decoding and encoding as Arrow stages at the file boundary, and Douglas-Peucker simplification."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"]
_POSITION = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEOM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_POSITION))))])

_ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])


class WkbError(ValueError):
    pass


def parse(data: bytes) -> tuple[str, list]:
    """Kind and parts of one geometry, of either byte order; raises WkbError with the reason."""
    kind, parts, at = _read(data, 0, None)
    if at != len(data):
        raise WkbError("TRAILING_BYTES")
    return kind, parts


def _read(data: bytes, at: int, want: int | None):
    if at + 5 > len(data):
        raise WkbError("TRUNCATED")
    if data[at] not in (0, 1):
        raise WkbError("BYTE_ORDER")
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    if want is not None and code != want:
        raise WkbError("NESTED_TYPE")
    if not 1 <= code <= 6:
        raise WkbError("UNKNOWN_TYPE")
    at += 5

    def count() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise WkbError("TRUNCATED")
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        return n

    def run(n: int) -> list:
        nonlocal at
        if at + 16 * n > len(data):
            raise WkbError("TRUNCATED")
        xy = np.frombuffer(data, order + "f8", 2 * n, at).astype(float).reshape(-1, 2)
        at += 16 * n
        return [{"x": x, "y": y} for x, y in xy.tolist()]

    if code == 1:
        return KINDS[0], [[run(1)]], at
    if code == 2:
        return KINDS[1], [[run(count())]], at
    if code == 3:
        return KINDS[2], [[run(count()) for _ in range(count())]], at
    parts = []
    for _ in range(count()):
        _, inner, at = _read(data, at, code - 3)
        parts += inner
    return KINDS[code - 1], parts, at


def write(kind: str, parts: list) -> bytes:
    """Little-endian WKB."""
    code = KINDS.index(kind) + 1

    def points(ring) -> bytes:
        return np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes()

    def one(c: int, part) -> bytes:
        head = struct.pack("<BI", 1, c)
        if c == 1:
            return head + points(part[0])
        if c == 2:
            return head + struct.pack("<I", len(part[0])) + points(part[0])
        return head + struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in part)

    if code <= 3:
        return one(code, parts[0])
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(one(code - 3, p) for p in parts)


def _add(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with further columns that ``make`` gives for each Arrow batch; its own columns pass through."""
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    source = df.select(*kept)
    schema = T.StructType([*source.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make({n: batch.column(k) for k, n in enumerate(kept)})
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def decode_wkb(df: DataFrame, col: str, into: str = "geom") -> DataFrame:
    """Adds ``into`` and ``into``_error; a broken value has a null geometry and the reason."""

    def make(columns):
        geoms, errors = [], []
        for v in columns[col].to_pylist():
            try:
                kind, parts = parse(v) if v is not None else (None, None)
                geoms.append({"kind": kind, "parts": parts} if kind else None)
                errors.append(None)
            except WkbError as x:
                geoms.append(None)
                errors.append(str(x))
        return pa.array(geoms, _ARROW), pa.array(errors, pa.string())

    return _add(df, [T.StructField(into, _GEOM), T.StructField(f"{into}_error", T.StringType())], make)


def encode_wkb(df: DataFrame, col: str = "geom", into: str = "wkb") -> DataFrame:
    """Adds the geometry as little-endian WKB; null stays null."""
    make = lambda columns: [pa.array([write(g["kind"], g["parts"]) if g else None for g in columns[col].to_pylist()], pa.binary())]
    return _add(df, [T.StructField(into, T.BinaryType())], make)


def _thin(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker without recursion: which vertices stay."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        n = float(d @ d)
        t = np.clip(p @ d / n, 0, 1) if n else np.zeros(len(p))
        away = ((p - t[:, None] * d) ** 2).sum(1)
        k = int(away.argmax())
        if away[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep]


def simplify_layer(df: DataFrame, tolerance: float = 0.0, max_vertices: int = 10000, col: str = "geom") -> DataFrame:
    """Adds simplified, vertex_count and status; the tolerance doubles from one metre, twelve times at most, while there are too many."""

    def thin(parts, kind, tol):
        out = []
        for p in parts:
            rings = []
            for r in p:
                xy = np.array([(q["x"], q["y"]) for q in r], float)
                t = _thin(xy, tol)
                rings.append(xy if kind.endswith("Polygon") and len(t) < 4 else t)
            out.append(rings)
        return out

    size = lambda parts: sum(len(r) for p in parts for r in p)

    def one(geom):
        if not geom or geom["kind"] is None:
            return None, None, None, None
        kind, parts = geom["kind"], geom["parts"] or []
        new = [[np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2) for r in p] for p in parts]
        before = size(new)
        if not kind.endswith("Point"):
            if tolerance > 0:
                new = thin(parts, kind, tolerance)
            step = 0
            while size(new) > max_vertices and step < 12:
                new = thin(parts, kind, max(tolerance, 1.0) * 2**step)
                step += 1
        n = size(new)
        shown = [[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in new]
        return {"kind": kind, "parts": shown}, n != before, n, "OK" if n <= max_vertices else "VERTEX_LIMIT_EXCEEDED"

    def make(columns):
        rows = [one(g) for g in columns[col].to_pylist()]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((_ARROW, pa.bool_(), pa.int32(), pa.string()))]

    fields = [T.StructField("_simplified_geom", _GEOM), T.StructField("simplified", T.BooleanType()), T.StructField("vertex_count", T.IntegerType()), T.StructField("status", T.StringType())]
    return _add(df, fields, make).withColumn(col, F.col("_simplified_geom")).drop("_simplified_geom")
