"""Operators against brute force and the documented rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from boundra.functions.ids import decode_id, encode_id
from boundra.operators import catalog, planning, quality, snapshots
from boundra.operators.search import adaptive_cap
from boundra.operators.spatial import bbox_candidates
from boundra.sources.storage import write_snapshot
from boundra.sources.wkb import simplify_layer

SMALL = "/root/testdata/sf0.001"


def test_bbox_join_equals_brute_force(spark):
    r = random.Random(1)

    def boxes(n, tag):
        out = []
        for k in range(n):
            x, y, w, h = r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0, 1, 30, 700]), r.choice([0, 2, 50, 300])
            out.append((f"{tag}{k}", x, y, x + w, y + h))
        return out

    a, b = boxes(60, "a"), boxes(60, "b")
    left = spark.createDataFrame(a, "l string, min_x double, min_y double, max_x double, max_y double")
    right = spark.createDataFrame(b, "r string, min_x double, min_y double, max_x double, max_y double")
    found = sorted(map(tuple, bbox_candidates(left, right).collect()))
    assert found == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_adaptive_cap_equals_loop(spark):
    r = random.Random(2)
    rows = [(g, p, r.random() < share) for g, n, share in ((1, 40, 0.5), (2, 400, 0.01), (3, 900, 0.002), (4, 5, 0.9)) for p in range(1, n + 1)]
    out = adaptive_cap(spark.createDataFrame(rows, "g int, place int, hit boolean"), ["g"], 2).collect()
    want = []
    for g in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == g]
        cap = 10
        while True:
            seen = own[:cap]
            hits = [x for x in seen if x[2]]
            if len(hits) >= 2 or len(seen) < cap or cap * 2 > 200:
                break
            cap *= 2
        want += hits
    assert sorted(map(tuple, ((x.g, x.place, x.hit) for x in out))) == sorted(want)


def test_dimensions(spark):
    assert catalog.layers_table(spark).count() == 54 and catalog.layers_table(spark).filter("channel = 'wfs'").count() == 52
    sizes = {r.profile: r.n for r in catalog.profiles_table(spark).groupBy("profile").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"administrative": 7, "administrative-history": 5, "cadastre-boundaries": 2, "jurisdictions": 33, "maritime": 12, "addresses": 2, "boundaries-full": 52, "poland-full": 54}
    assert {r.package: len(r.layer_ids) for r in catalog.packages_table(spark).collect()}["granice_specjalne"] == 45


def test_run_report(spark):
    rows = [(1, "published"), (1, "failed"), (2, "failed"), (3, "unchanged")]
    assert {r.run_id: r.status for r in planning.run_report(spark.createDataFrame(rows, "run_id int, status string")).collect()} == {1: "partial", 2: "failed", 3: "complete"}


def test_current_snapshot_beats_archive(spark):
    cov = spark.createDataFrame([("A03", "current:A03", 0, "country", "PL", 1, "complete"), ("A03", "archive:2024:A03", 2024, "country", "PL", 2, "complete")], "layer_id string, dataset_key string, archive_year int, scope_type string, scope_code string, snapshot_id int, completeness string")
    assert [r.snapshot_id for r in snapshots.current_snapshots(cov).collect()] == [1]
    areas = spark.createDataFrame([("A03", 1), ("A03", 2)], "layer_id string, snapshot_id int")
    assert snapshots.select_snapshot(areas, "current", current=snapshots.current_snapshots(cov.limit(0))).count() == 0


def test_validation_finds_injected_defects(spark):
    good = [("d", "address", f"o{k}", "EPSG:2180", "s1", 0.0, 0.0, 1.0, 1.0) for k in range(5)]
    bad = [("d", "address", "o0", "EPSG:2180", "s1", 0.0, 0.0, 1.0, 1.0), ("d", "address", "p", "EPSG:4326", "s9", 0.0, 0.0, float("nan"), 1.0), ("d", "address", "q", "EPSG:2180", None, 0.0, 0.0, 2e6, 1.0)]
    records = spark.createDataFrame(good + bad, "dataset_key string, record_type string, object_id string, crs string, street_id string, min_x double, min_y double, max_x double, max_y double")
    streets = spark.createDataFrame([("s1",)], "object_id string")
    manifest = spark.createDataFrame([("d", 9)], "dataset_key string, expected int")
    out = sorted((r.code, r.object_id or "") for r in quality.validate_dataset(records, streets, manifest).collect())
    assert out == sorted([("DUPLICATE_ID", "o0"), ("DUPLICATE_ID", "o0"), ("INVALID_CRS", "p"), ("INVALID_BBOX", "p"), ("BROKEN_REFERENCE", "p"), ("OUTSIDE_POLAND", "q"), ("MANIFEST_MISMATCH", "")])
    assert quality.validate_dataset(records, streets.limit(0), manifest).filter("code = 'BROKEN_REFERENCE'").count() == 0


def test_page_after_stale(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [r.status for r in quality.page_after(df, ["k"], [F.lit(0)], 5, "old", "new").collect()] == ["CURSOR_STALE"]
    assert [r.k for r in quality.page_after(df, ["k"], [F.lit(1)], 5, "v", "v").collect()] == [2]


REGISTER = ["locate_points_covers", "relate_areas_intersects", "reverse_candidate_limit", "search_addresses_ranked", "coverage_summary", "sync_decisions", "assign_partition", "gml_ingest", "csv_ingest", "incremental_ingest"]
REGISTER += ["relate_areas_statuses", "polish_order", "search_structured", "request_rules", "cursor_pages", "gml_streets", "boundary_layer", "snapshot_staging", "page_files", "file_set_fingerprints", "schema_drift", "simplify_layer", "sql_functions_all"]

REGISTER += ["relate_areas_tested", "nearest_per_request", "cursor_pages_many", "as_of_versions", "search_index_segments", "publication_versions", "package_ingest", "geojson_export_wgs84", "sql_functions_projections", "sync_decisions_all_modes"]


@pytest.mark.parametrize("name", REGISTER)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SMALL)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert key(df.select(*columns).collect()) == key([[r[i] for i in order] for r in want.fetchall()])


def test_a_failed_snapshot_leaves_the_old_one(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    good = spark.createDataFrame([(1,), (2,)], "k int")
    wrong = lambda df: df.filter("k < 0").select(F.lit("NEGATIVE").alias("code"))
    assert write_snapshot(good, root, 1, wrong).first().status == "published"
    row = write_snapshot(spark.createDataFrame([(-1,)], "k int"), root, 1, wrong).first()
    assert (row.status, row.error, row.records) == ("failed", "NEGATIVE", 1)
    assert sorted(r.k for r in spark.read.parquet(root).collect()) == [1, 2]
    write_snapshot(good.limit(1), root, 1, wrong)
    assert spark.read.parquet(root).count() == 1 and not [p for p in (tmp_path / "snapshots").iterdir() if p.name.startswith("_")]


def test_ids_of_any_length_come_back(spark):
    text = "ż" * 300 + '"\\ +/='
    df = spark.createDataFrame([(text,)], "v string").withColumn("id", encode_id(objectId=F.col("v")))
    row = df.withColumn("back", decode_id(F.col("id"), "objectId string")).first()
    assert row.back.objectId == text and row.id.isascii() and not set(row.id) & set("+/=\r\n")


def test_rings_of_any_sizes_are_simplified(spark):
    ring = lambda n, r: [{"x": float(r * (k % n)), "y": float((k % n) ** 2)} for k in range(n + 1)]
    geom = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
    rows = [(1, {"kind": "Polygon", "parts": [[ring(9, 1), ring(4, 1)]]}), (2, {"kind": "MultiPolygon", "parts": [[ring(5, 1)], [ring(6, 2), ring(3, 1), ring(12, 1)]]}), (3, None), (4, {"kind": "LineString", "parts": []})]
    out = {r.k: r for r in simplify_layer(spark.createDataFrame(rows, f"k int, geom {geom}"), tolerance=0.5).collect()}
    assert out[1].vertex_count <= 15 and [len(r) for r in out[2].geom.parts[1]][1] >= 4 and out[3].geom is None and out[4].status == "OK"


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
