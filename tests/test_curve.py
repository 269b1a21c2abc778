"""Storage along a curve: what is read near requests, and that nothing that they meet is missing."""

import random

from pyspark.sql import functions as F

from boundra.sources.curve import curve, read_near, write_along_curve
from boundra.sources.storage import shared_path


def files_of(df):
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_requests_of_a_county_read_few_files(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(0, 700_000), r.uniform(0, 700_000)) for i in range(20_000)]
    path = shared_path(spark, "addresses")
    write_along_curve(spark.createDataFrame(rows, "object_id long, x double, y double"), path, 64)
    asked = [(300_000 + r.uniform(0, 40_000), 200_000 + r.uniform(0, 40_000)) for _ in range(100)]
    requests = spark.createDataFrame([(x - 500, y - 500, x + 500, y + 500) for x, y in asked], "x1 double, y1 double, x2 double, y2 double")
    near = read_near(spark, path, requests)
    found = {r.object_id for r in near.collect()}
    assert {i for i, x, y in rows if any(abs(x - a) <= 500 and abs(y - b) <= 500 for a, b in asked)} <= found and len(found) < 500
    assert len(files_of(near)) <= 6 < 64 == len(files_of(spark.read.parquet(path)))
    assert "PushedFilters: [Or" in near._jdf.queryExecution().executedPlan().toString() or "LessThanOrEqual(min_x" in near._jdf.queryExecution().executedPlan().toString()


def test_areas_and_special_rows(spark):
    rows = [("big", -1e9, -1e9, 1e9, 1e9), ("a", 0.0, 0.0, 10.0, 10.0), ("far", 9e5, 9e5, 9.1e5, 9.1e5), ("none", None, None, None, None)]
    path = shared_path(spark, "areas")
    write_along_curve(spark.createDataFrame(rows, "object_id string, min_x double, min_y double, max_x double, max_y double"), path, 4)
    one = spark.createDataFrame([(5.0, 5.0, 5.0, 5.0), (None, None, None, None)], "x1 double, y1 double, x2 double, y2 double")
    assert {r.object_id for r in read_near(spark, path, one).collect()} == {"big", "a"}
    assert read_near(spark, path, one.filter("false")).count() == 0


def test_neighbours_on_the_curve(spark):
    cells = spark.range(64).selectExpr("id", "id % 8 AS i", "floor(id / 8) AS j")
    got = {(r.i, r.j): r.c for r in cells.select("i", "j", (curve(F.col("i") * 32.0 - 524_288, F.col("j") * 32.0 - 524_288)).alias("c")).collect()}
    assert got == {(i, j): sum(((i >> b & 1) << 2 * b) | ((j >> b & 1) << 2 * b + 1) for b in range(3)) for i in range(8) for j in range(8)}
