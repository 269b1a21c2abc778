"""Steps that must not grow faster than their input, against SQL and brute force."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from boundra.operators import quality
from boundra.operators.spatial import overlap_counts

SMALL = "/root/testdata/sf0.001"


def test_fields_of_rows_with_nulls(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(300)
    rows = rows.withColumn("l_returnflag", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag"))).withColumn("l_linestatus", F.when(F.col("l_linenumber") > 1, "1e3")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE TABLE lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = __spark_entry__.queries()["schema_drift"](spark, str(tmp_path))
    want = con.sql(__spark_entry__.oracle_sql()["schema_drift"])
    assert list(map(tuple, found.select(*want.columns).collect())) == want.fetchall()
    plan = quality.table_fields(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # fields are made of the table's one row of aggregates, not of each of its rows


def test_overlaps_are_counted_without_pairs(spark):
    r = random.Random(7)

    def boxes(n):
        out = []
        for k in range(n):
            x, y, w, h = r.randint(-20, 20), r.randint(-20, 20), r.choice([0, 1, 3, 30]), r.choice([0, 2, 5, 30])
            out.append((k, float(x), float(y), float(x + w), float(y + h)))
        return out

    a, b = boxes(150), boxes(220)
    left, right = (spark.createDataFrame(x, "k int, min_x double, min_y double, max_x double, max_y double") for x in (a, b))
    found = dict(map(tuple, overlap_counts(left, right, ["k"]).collect()))
    assert found == {p[0]: sum(p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4] for q in b) for p in a}


def test_counting_candidates_makes_no_pairs(spark, monkeypatch):
    from boundra.plans import spatial_queries

    monkeypatch.setattr(spatial_queries, "bbox_candidates", None)
    assert __spark_entry__.queries()["relate_areas_tested"](spark, SMALL).count() > 0


def test_points_meet_no_more_areas_than_a_batch_takes(spark, monkeypatch):
    """300 areas over every point: the first in order only are met, and no ceiling refuses what the query doesn't bound."""
    from boundra.operators import spatial
    from boundra.plans.fixtures import with_box

    square = "named_struct('kind', 'Polygon', 'parts', array(array(transform(array(0, 9, 9, 0, 0), (v, i) -> named_struct('x', cast(v AS double), 'y', cast(element_at(array(0, 0, 9, 9, 0), i + 1) AS double))))))"
    areas = with_box(spark.range(300).selectExpr("'L' AS layer_id", "lpad(id, 3, '0') AS object_id", "'n' AS name", "1L AS snapshot_id", f"{square} AS geom"))
    points = spark.range(50).selectExpr("id AS point_id", "id % 9 AS x", "id % 7 AS y")
    met, plain = [], spatial.bbox_candidates

    def counted(left, right, *more):
        met.append(right.count())
        return plain(left, right, *more)

    monkeypatch.setattr(spatial, "bbox_candidates", counted)
    found = spatial.locate_points(points, areas, limit=3, max_candidates=None).collect()
    assert {(x.point_id, x.rank, x.object_id) for x in found} == {(p, k + 1, f"00{k}") for p in range(50) for k in range(3)} and sum(met) < 30
    assert {(x.point_id, x.status) for x in spatial.locate_points(points, areas, limit=3, max_candidates=299).collect()} == {(p, "COST_LIMIT_EXCEEDED") for p in range(50)}


def test_exported_positions_are_projected_once(spark):
    """Inside lambdas Spark finds no equal parts: the projection's text must not hold them again and again. Values stay the same, rows are spread."""
    from boundra.functions.crs import map_positions, to_4326
    from boundra.plans import fixtures as fx
    from boundra.sources.storage import export_geojson

    a = fx.areas(spark, SMALL).withColumn("geom", map_positions(F.col("geom"), lambda x, y: F.struct((x + 5e5).alias("x"), (y + 4.8e5).alias("y"))))
    layers = a.select("layer_id", F.lit("c").alias("category"), F.lit("polygon").alias("geometry")).distinct()
    out = export_geojson(a, None, layers, "EPSG:4326")
    assert out._jdf.queryExecution().optimizedPlan().toString().upper().count("ATANH") < 50
    assert out.rdd.getNumPartitions() == 4
    at = lambda k: F.get_json_object("feature", f"$.geometry.coordinates[0][0][{k}]").cast("double")
    corner = F.get(F.get(F.get("geom.parts", 0), 0), 0)
    plain = a.withColumn("g", to_4326(corner["x"], corner["y"])).select("layer_id", "object_id", "g.lon", "g.lat")
    assert sorted(map(tuple, out.select("layer_id", "object_id", at(0), at(1)).collect())) == sorted(map(tuple, plain.collect()))


def test_words_of_a_small_file_are_found_by_all_tasks(spark, tmp_path, monkeypatch):
    from boundra.operators import search_index as si

    docs, seen, plain = spark.range(300).selectExpr("0 AS part", "cast(id AS string) AS doc", "concat('word w', id % 7) AS text").coalesce(1), [], si.tokenised

    def counted(df, *more):
        seen.append(df.rdd.getNumPartitions())
        return plain(df, *more)

    monkeypatch.setattr(si, "tokenised", counted)
    si.add_documents(docs, f"{tmp_path}/i", "part", "doc", {"text": 1.0})
    assert seen == [4]
    rows = spark.read.parquet(f"{tmp_path}/i/segment-*/blocks")
    assert {(r.token, r.n) for r in rows.groupBy("token").agg(F.sum(F.bit_count("mask")).alias("n")).collect()} == {("word", 300), *((f"w{k}", len(range(k, 300, 7))) for k in range(7))}


def test_structured_requests_that_ask_the_same_are_ranked_once(spark, monkeypatch):
    from boundra.operators import search

    addresses = spark.range(30).selectExpr("id % 3 AS shard", "lpad(id, 2, '0') AS object_id", "'Town' AS locality_name", "'Street' AS street_name", "cast(id % 2 AS string) AS building_number", "cast(NULL AS string) AS postal_code")
    requests = spark.range(400).selectExpr("id AS request_id", "cast(id % 2 AS string) AS number", "CASE WHEN id % 4 < 2 THEN array(0L, 2L) END AS shards")
    ranked, plain = [], search.top_k

    def counted(df, *more):
        ranked.append(df.count())
        return plain(df, *more)

    monkeypatch.setattr(search, "top_k", counted)
    found = search.match_structured(requests, addresses, 7)
    asked = lambda r: [a for a in range(30) if a % 2 == r % 2 and (r % 4 >= 2 or a % 3 != 1)][:7]
    assert {(x.request_id, x.rank, int(x.object_id)) for x in found.collect()} == {(r, k + 1, a) for r in range(400) for k, a in enumerate(asked(r))}
    assert sum(ranked) < 150  # and not a row for each request


def test_boxes_of_very_different_size_dont_all_meet(spark, monkeypatch):
    from boundra.operators import spatial

    boxes = "SELECT id AS {0}id, cast(3 * id AS double) AS min_x, 0D AS min_y, 3 * id + 1D AS max_x, 1D AS max_y FROM range(400) UNION ALL SELECT 400, 0D, 0D, 4000D, 4000D"
    laid, plain = [], spatial._with_cells

    def counted(df, level):
        laid.append(plain(df, level))
        return laid[-1]

    monkeypatch.setattr(spatial, "_with_cells", counted)
    found = spatial.bbox_candidates(spark.sql(boxes.format("l")), spark.sql(boxes.format("r"))).collect()
    assert sorted(map(tuple, found)) == sorted([(k, k) for k in range(401)] + [(k, 400) for k in range(400)] + [(400, k) for k in range(400)])
    met = sum(a.alias("a").join(b.alias("b"), [*("_level", "_cx", "_cy")]).count() for a, b in zip(laid[::2], laid[1::2]))
    assert met < 10_000  # and not 400 * 400 in the large one's cell


def test_validation_moves_no_whole_records(spark):
    text = "dataset_key string, record_type string, object_id string, crs string, street_id string, min_x double, min_y double, max_x double, max_y double"
    good = ("address", "o", "EPSG:2180", "s", 0.0, 0.0, 1.0, 1.0)
    records = spark.createDataFrame([("a", *good), ("a", *good), ("a", *good), ("b", "address", "p", None, "t", 0.0, 0.0, 3e6, 1.0), ("c", "address", None, "EPSG:2180", None, 1.0, 0.0, 0.0, 1.0)], text)
    streets, manifest = spark.createDataFrame([("s",)], "object_id string"), spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "dataset_key string, expected bigint")
    found = quality.validate_dataset(records, streets, manifest)
    assert sorted((x.dataset_key, str(x.object_id), x.code) for x in found.collect()) == sorted([("a", "o", "DUPLICATE_ID")] * 3 + [("b", "p", c) for c in ("INVALID_CRS", "OUTSIDE_POLAND", "BROKEN_REFERENCE")] + [("b", "None", "MANIFEST_MISMATCH"), ("c", "None", "INVALID_BBOX")])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_packages_take_their_records_once(spark, monkeypatch):
    from boundra.plans import ingest_queries

    made, plain = spark.sparkContext.accumulator(0), ingest_queries._lines
    rows = plain(spark, SMALL).count()

    def seen(part):
        made.add(1)
        return part

    monkeypatch.setattr(ingest_queries, "_lines", lambda *a: plain(*a).withColumn("l_partkey", F.udf(seen, "bigint")("l_partkey")))
    assert ingest_queries.package_ingest(spark, SMALL).count() > 0
    assert made.value == rows


def test_pages_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from boundra.plans import register_queries

    monkeypatch.setattr(register_queries, "shared_path", lambda *a: f"{tmp_path}/pages")
    register_queries.page_files(spark, SMALL).collect()
    assert len({p.name.split("-")[1] for p in tmp_path.glob("pages/*/part-*")}) == 4
    kept, lost = quality.read_page_files(spark, f"{tmp_path}/pages", 8001)
    assert "text(" not in kept._jdf.queryExecution().optimizedPlan().toString().lower() and lost.filter("bytes <= 8001").isEmpty()
    texts = sorted(r.html or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect() if len((r.html or "").encode()) <= 8000)
    assert sorted(r.value[:-1] for r in kept.collect()) == texts


def test_fingerprints_move_packed(spark):
    rows = [("a.shp", "ab"), ("a.shx", "AB"), ("a.dbf", ""), ("a.prj", "abc"), ("b.shp", "Ab"), ("b.shx", "ab"), ("b.dbf", "ab"), ("b.prj", "ab"), ("c.shp", "ab"), ("c.x", "ab")]
    listing = spark.createDataFrame(rows, "path string, fingerprint string")
    found = quality.check_file_sets(listing, spark.createDataFrame([("ab",), ("AB",), ("",), ("abc",), ("ab",)], "fingerprint string"))
    every = "attributes,index,projection,shape"
    assert sorted(map(tuple, found.collect())) == [("a", every, "", "OK"), ("b", every, "", "NOT_ALLOWED"), ("c", "shape", "attributes,index,projection", "UNSUPPORTED")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan and "collect_set" not in plan


def test_texts_dont_move_for_documents_of_rare_words(spark):
    from boundra.operators.search import text_search

    docs = spark.range(200).selectExpr("0 AS part", "id AS doc", "concat('all w', id % 50) AS text")
    asked = spark.createDataFrame([(1, ["all", "w7"])], "request_id int, words array<string>")
    found = text_search(asked, docs, "part", "doc", {"text": 1.0})
    assert {r.doc for r in found.collect()} == {k for k in range(200) if k % 50 == 7}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
