"""Where tables are written: the shared folder, staged snapshots, partitions, GeoJSON."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.functions.crs import map_positions, to_4326
from boundra.functions.geometry import let, validate_geometry, vertex_count
from boundra.operators.snapshots import current_snapshots, select_snapshot, upsert
from boundra.sources.wkb import simplify_layer

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, in one of a local session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read back: its lineage ends there, so lost executors cost no more than a stage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, root: str, snapshot_id: int, violations: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stage, check and publish one snapshot's rows: a row with status, records, error and path.

    The rows are written to a new folder; ``violations`` gives what is wrong with them as they are read back, and if
    that has rows, nothing is published. Then the folder takes its place as ``snapshot_id=N``; one that stood there is
    kept beside until that has been done and put back if it fails. Others stay readable throughout.
    """
    spark = df.sparkSession
    path, stage, kept = (f"{root.rstrip('/')}/{x}" for x in (f"snapshot_id={snapshot_id}", f"_stage-{uuid.uuid4().hex}", f"_kept-{uuid.uuid4().hex}"))
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.drop("snapshot_id").write.parquet(stage)
    staged = spark.read.parquet(stage)
    records = staged.count()
    wrong = violations(staged).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code")).first() if violations else None
    if wrong and wrong.n:
        fs.delete(at(stage), True)
        return spark.range(1).select(F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), F.lit("failed").alias("status"), F.lit(records).cast("bigint").alias("records"), F.lit(wrong.code).alias("error"), F.lit(None).cast("string").alias("path"))
    before = fs.exists(at(path))
    if before:
        fs.rename(at(path), at(kept))
    if not fs.rename(at(stage), at(path)):
        if before:
            fs.rename(at(kept), at(path))
        raise OSError(f"{path} can't be published")
    if before:
        fs.delete(at(kept), True)
    return spark.range(1).select(F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), F.lit("published").alias("status"), F.lit(records).cast("bigint").alias("records"), F.lit(None).cast("string").alias("error"), F.lit(path).alias("path"))


def publish(coverage: DataFrame, rows: DataFrame) -> DataFrame:
    """The coverage table with its pointers moved to the new snapshots, all at once."""
    return upsert(coverage, rows, ["layer_id", "dataset_key", "archive_year", "scope_type", "scope_code"])


def write_address_partitions(records: DataFrame, path: str) -> None:
    """One folder for each voivodeship; rows are spread by partition and a part number, so a large one isn't one task's."""
    spread = records.withColumn("_part", F.pmod(F.xxhash64("object_id"), F.lit(8)))
    spread.repartition("voivodeship_code", "_part").drop("_part").write.mode("overwrite").partitionBy("voivodeship_code").parquet(path)


def export_geojson(areas: DataFrame, coverage: DataFrame | None, layers: DataFrame, crs: str = "EPSG:2180", max_vertices: int = 10000, keys: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """GeoJSON features of boundary layers as rows: layer_id, object_id, status, feature (JSON text).

    Without ``coverage`` every snapshot is taken, else the current ones; with ``keys`` (layer_id, object_id) only
    those areas. With a ``tolerance`` lines and rings are simplified first, in metres.
    """
    if crs not in ("EPSG:2180", "EPSG:4326"):
        raise ValueError(f"INVALID_INPUT: {crs}")
    a = areas if coverage is None else select_snapshot(areas, "current", current=current_snapshots(coverage))
    a = a.join(F.broadcast(layers.filter("category <> 'address' AND geometry <> 'point'").select("layer_id")), "layer_id", "left_semi")
    a = a if keys is None else a.join(keys.select("layer_id", "object_id").distinct(), ["layer_id", "object_id"], "left_semi")
    a = simplify_layer(a, tolerance, 2**31 - 1).drop("vertex_count", "status") if tolerance > 0 else a.withColumn("simplified", F.lit(False))
    g = F.col("geom")
    if crs == "EPSG:4326":
        # positions outside the degrees' range have no coordinates
        g = map_positions(g, lambda x, y: let(to_4326(x, y, let), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    # a small file would be one task's, which makes all texts; what is used several times is computed once
    a = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = a.withColumn("_g", F.explode(F.array(g))).withColumn("_f", F.explode(F.array(F.struct(vertex_count(F.col("geom")).alias("n"), validate_geometry(F.col("geom")).alias("e"))))).select("*", F.col("_f.n").alias("_n"), F.col("_f.e").alias("_e"))
    pair = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    parts = F.col("_g.parts")
    shown = {
        "Polygon": F.to_json(F.transform(F.get(parts, 0), pair)), "MultiPolygon": F.to_json(F.transform(parts, lambda p: F.transform(p, pair))), "LineString": F.to_json(pair(F.get(F.get(parts, 0), 0))),
        "MultiLineString": F.to_json(F.transform(parts, lambda p: pair(F.get(p, 0)))), "MultiPoint": F.to_json(F.transform(parts, lambda p: F.get(pair(F.get(p, 0)), 0))),
    }
    coordinates = None
    for kind, text in shown.items():
        coordinates = F.when(F.col("_g.kind") == kind, text) if coordinates is None else coordinates.when(F.col("_g.kind") == kind, text)
    properties = F.to_json(F.struct(F.col("layer_id").alias("layerId"), F.col("object_id").alias("objectId"), F.col("snapshot_id").alias("snapshotId"), "name", "simplified", F.col("_n").alias("vertexCount")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), F.col("_g.kind"), F.lit('","coordinates":'), coordinates, F.lit("}}"))
    status = F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_n") > max_vertices, "VERTEX_LIMIT_EXCEEDED").otherwise("OK")
    return a.select("layer_id", "object_id", status.alias("status"), F.when(status == "OK", feature).alias("feature"))
