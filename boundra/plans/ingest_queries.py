"""Driver queries of sources, sinks and the incremental ingest; files are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundra.operators.catalog import layers_table
from boundra.plans import fixtures as fx
from boundra.plans.registry import query, table
from boundra.sources import gml
from boundra.sources.publication import publish_snapshots, read_snapshots, read_table
from boundra.sources.storage import export_geojson, publish, shared_path, write_address_partitions, write_snapshot, written
from boundra.sources.wkb import decode_wkb, encode_wkb, simplify_layer
from boundra.streaming.ingest import incremental_ingest
from boundra.streaming.packages import ingest_packages


@query(
    "wkb_round_trip",
    f"WITH {fx.AREAS} SELECT layer_id, object_id, 'Polygon' AS kind, CASE WHEN k % 3 = 0 THEN 209 ELSE 125 END AS bytes, true AS same FROM a",
)
def wkb_round_trip(spark, sf_dir):
    a = fx.areas(spark, sf_dir).select("layer_id", "object_id", "geom")
    back = decode_wkb(encode_wkb(a), "wkb", "back")
    return back.select("layer_id", "object_id", F.col("back.kind").alias("kind"), F.length("wkb").alias("bytes"), (F.to_json("geom") == F.to_json("back")).alias("same"))


@query(
    "simplify_layer",
    """WITH RECURSIVE p AS (
  SELECT CAST(vec_id AS VARCHAR) AS object_id, unnest(range(0, 8)) AS j, embedding AS e FROM embeddings
), q AS MATERIALIZED (
  SELECT object_id, j, CAST(floor(CAST(e[2 * j + 1] AS DOUBLE) * 100000) AS DOUBLE) AS x, CAST(floor(CAST(e[2 * j + 2] AS DOUBLE) * 100000) AS DOUBLE) AS y FROM p
), s AS (
  SELECT object_id, unnest(range(0, 12)) AS step, CAST(0 AS BIGINT) AS a, CAST(7 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS kept FROM (SELECT DISTINCT object_id FROM q)
  UNION ALL
  SELECT object_id, step, CASE WHEN side = 0 THEN a ELSE far END, CASE WHEN side = 0 THEN far ELSE b END, CASE WHEN side = 0 THEN far END FROM (
    SELECT object_id, step, a, b, first(j ORDER BY away DESC, j) AS far, max(away) AS most, unnest([0, 1]) AS side FROM (
      SELECT s.object_id, step, a, b, m.j, power(m.x - u.x - t * (w.x - u.x), 2) + power(m.y - u.y - t * (w.y - u.y), 2) AS away FROM (
        SELECT s.*, m.j AS mj, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, ((m.x - u.x) * (w.x - u.x) + (m.y - u.y) * (w.y - u.y)) / n)) END AS t FROM (
          SELECT s.*, power(w.x - u.x, 2) + power(w.y - u.y, 2) AS n FROM s JOIN q u ON u.object_id = s.object_id AND u.j = a JOIN q w ON w.object_id = s.object_id AND w.j = b WHERE b - a >= 2) s
        JOIN q u ON u.object_id = s.object_id AND u.j = a JOIN q w ON w.object_id = s.object_id AND w.j = b JOIN q m ON m.object_id = s.object_id AND m.j > a AND m.j < b) s
      JOIN q u ON u.object_id = s.object_id AND u.j = a JOIN q w ON w.object_id = s.object_id AND w.j = b JOIN q m ON m.object_id = s.object_id AND m.j = mj)
    GROUP BY object_id, step, a, b) WHERE most > power(3000 * power(2, step), 2)
), n AS (SELECT object_id, step, 2 + count(kept) AS n FROM s GROUP BY ALL),
best AS (SELECT object_id, coalesce(min(step) FILTER (n <= 5), 11) AS step FROM n GROUP BY object_id)
SELECT object_id, n <> 8 AS simplified, n AS vertex_count, CASE WHEN n <= 5 THEN 'OK' ELSE 'VERTEX_LIMIT_EXCEEDED' END AS status FROM n JOIN best USING (object_id, step)""",
)
def q_simplify_layer(spark, sf_dir):
    lines = fx.lines(spark, sf_dir).select("object_id", "geom")
    s = simplify_layer(lines, tolerance=3000.0, max_vertices=5)
    return s.select("object_id", "simplified", "vertex_count", "status")


@query(
    "geojson_export",
    f"""WITH {fx.AREAS} SELECT layer_id, object_id, 'OK' AS status, 'Polygon' AS kind, CASE WHEN k % 3 = 0 THEN 12 ELSE 7 END AS vertices, CAST(cx - h AS DOUBLE) AS first_x, CAST(cy - h AS DOUBLE) AS first_y FROM a WHERE layer_id <> 'L01'""",
)
def geojson_export(spark, sf_dir):
    layers = spark.range(2).select(F.concat(F.lit("L0"), (F.col("id") + 2).cast("string")).alias("layer_id"), F.lit("administrative").alias("category"), F.lit("polygon").alias("geometry"))
    out = export_geojson(fx.areas(spark, sf_dir), None, layers.unionByName(layers_table(spark).select("layer_id", "category", "geometry")))
    j = F.from_json("feature", "type string, properties struct<vertexCount:int>, geometry struct<type:string,coordinates:array<array<array<double>>>>")
    first = F.get(F.get(F.col("j.geometry.coordinates"), 0), 0)
    return out.withColumn("j", j).select("layer_id", "object_id", "status", F.col("j.geometry.type").alias("kind"), F.col("j.properties.vertexCount").alias("vertices"), F.get(first, 0).alias("first_x"), F.get(first, 1).alias("first_y"))


def _gml_addresses(spark, sf_dir):
    """Address packages of both layouts, written as text from the address table."""
    a = fx.addresses(spark, sf_dir)
    tag = lambda name, value: F.concat(F.lit(f"<ad:{name}>"), value, F.lit(f"</ad:{name}>"))
    pos = F.concat(F.lit("<gml:Point srsName=\"EPSG:2180\"><gml:pos>"), F.col("c_custkey").cast("string"), F.lit(" "), (F.col("c_custkey") * 2).cast("string"), F.lit("</gml:pos></gml:Point>"))
    iip = lambda kind: F.concat(F.lit(f"<ad:idIIP><ad:{kind}><ad:przestrzenNazw>NS</ad:przestrzenNazw><ad:lokalnyId>"), F.lpad("object_id", 8, "0"), F.lit(f"</ad:lokalnyId></ad:{kind}></ad:idIIP>"))
    common = F.concat(tag("miejscowosc", F.col("locality_name")), tag("ulica", F.col("street_name")), F.when(F.col("c_custkey") % 10 == 9, F.lit("")).otherwise(tag("numerPorzadkowy", F.col("building_number"))), F.lit("<ad:kodPocztowy>00-503</ad:kodPocztowy>"))
    old = F.concat(F.lit("<gml:featureMember><ad:AD_PunktAdresowy gml:id=\"a\">"), iip("BT_Identyfikator"), common, F.lit("<ad:waznyOd>2012-01-01</ad:waznyOd><ad:pozycja>"), pos, F.lit("</ad:pozycja></ad:AD_PunktAdresowy></gml:featureMember>"))
    new = F.concat(F.lit("<gml:featureMember><ad:AD_PunktAdresowy gml:id=\"a\">"), iip("AD_IdentyfikatorIIP"), common, F.lit("<ad:dataNadania>2021-05-05</ad:dataNadania><ad:georeferencja>"), pos, F.lit("</ad:georeferencja></ad:AD_PunktAdresowy></gml:featureMember>"))
    root = shared_path(spark, "gml")
    for year, body, part in (("2012", old, 0), ("2021", new, 1)):
        head = f'<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:ad="urn:gugik:emuia:1.0:{year}">'
        rows = a.filter(F.col("c_custkey") % 2 == part).select(F.floor(F.col("c_custkey") / 5000).alias("file"), body.alias("value"))
        # every file of a package is a document of its own, of a bounded number of features
        rows.groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), "\n"), F.lit("</gml:FeatureCollection>")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/{year}")
    return root


@query(
    "gml_ingest",
    f"""WITH {fx.ADDRESSES} SELECT CASE WHEN c_custkey % 10 = 9 THEN 'NO_NUMBER' ELSE 'OK' END AS status, lpad(object_id, 8, '0') AS object_id, CASE WHEN c_custkey % 10 <> 9 THEN CASE WHEN c_custkey % 2 = 0 THEN '2012-01-01' ELSE '2021-05-05' END END AS valid_from,
  CASE WHEN c_custkey % 10 <> 9 THEN '00503' END AS postal_code, CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey * 2 AS DOUBLE) END AS y FROM addresses""",
)
def gml_ingest(spark, sf_dir):
    root = _gml_addresses(spark, sf_dir)
    good, bad = gml.map_address_points(gml.read_features(spark, f"{root}/*", "AD_PunktAdresowy", gml.ADDRESS_SCHEMA))
    none = F.lit(None).cast("string")
    return good.select(F.lit("OK").alias("status"), "object_id", "valid_from", "postal_code", "y").unionByName(bad.select(F.col("reason").alias("status"), "object_id", none.alias("valid_from"), none.alias("postal_code"), F.lit(None).cast("double").alias("y")))


@query(
    "csv_ingest",
    f"WITH {fx.ADDRESSES} SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS municipality_code, locality_name, building_number, CAST(c_custkey AS DOUBLE) AS x FROM addresses WHERE c_custkey % 5 <> 4",
)
def csv_ingest(spark, sf_dir):
    k = F.col("c_custkey")
    piped = F.concat_ws("|", F.lpad(k.cast("string"), 7, "0"), "locality_name", F.concat(F.lit('"'), "street_name"), "building_number", F.lit("00-503"), F.when(k % 5 == 4, "x").otherwise(k.cast("string")), F.lit("1.5"))
    path = shared_path(spark, "csv")
    # the header stands in every file; quotes are text
    fx.addresses(spark, sf_dir).select(k.alias("id"), piped.alias("adruni")).write.option("header", "true").option("sep", ";").option("quote", "").csv(path)
    return gml.read_universal_addresses(spark, path).select("municipality_code", "locality_name", "building_number", "x")


@query(
    "field_mapping",
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'iip-' || CAST(p_partkey AS VARCHAR) END AS iip_id, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_name AS name, p_brand AS brand, p_partkey % 2 <> 0 AS hashed FROM part",
)
def field_mapping(spark, sf_dir):
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(F.lpad(k.cast("string"), 7, "0").alias("JPT_KOD_JE"), F.col("p_name").alias("JPT_NAZWA_"), F.when(k % 2 == 0, F.concat(F.lit("iip-"), k.cast("string"))).alias("IIP_IDENTY"), F.col("p_brand").alias("brand"))
    return gml.map_boundary_fields(raw).select("iip_id", "code", "name", F.col("properties")["brand"].alias("brand"), (F.length("object_id") == 64).alias("hashed"))


@query(
    "snapshot_publish",
    "SELECT 'A0' || CAST(s_suppkey % 5 AS VARCHAR) AS layer_id, CASE WHEN s_suppkey % 5 % 2 = 0 THEN 2 ELSE 1 END AS snapshot_id, count(*) AS records FROM supplier WHERE s_suppkey % 5 % 2 = 1 OR s_nationkey % 2 = 0 GROUP BY ALL",
)
def snapshot_publish(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.concat(F.lit("A0"), (F.col("s_suppkey") % 5).cast("string")).alias("layer_id"), "s_nationkey", (F.col("s_suppkey") % 5).alias("kind"))
    root = shared_path(spark, "areas")
    write_snapshot(n, root, 1)
    write_snapshot(n.filter("s_nationkey % 2 = 0 AND kind % 2 = 0"), root, 2)
    row = lambda df, s: df.select("layer_id", F.concat(F.lit("current:"), "layer_id").alias("dataset_key"), F.lit(0).alias("archive_year"), F.lit("country").alias("scope_type"), F.lit("PL").alias("scope_code"), F.lit(s).alias("snapshot_id"), F.lit("complete").alias("completeness")).distinct()
    pointers = publish(row(n, 1), row(n.filter("kind % 2 = 0"), 2))
    return spark.read.parquet(root).join(pointers.select("layer_id", "snapshot_id"), ["layer_id", "snapshot_id"]).groupBy("layer_id", "snapshot_id").agg(F.count(F.lit(1)).alias("records"))


@query("address_partitions", f"WITH {fx.ADDRESSES} SELECT lpad(CAST(shard * 2 + 2 AS VARCHAR), 2, '0') AS voivodeship_code, count(*) AS records FROM addresses GROUP BY ALL")
def address_partitions(spark, sf_dir):
    a = fx.addresses(spark, sf_dir).withColumn("voivodeship_code", F.lpad((F.col("shard") * 2 + 2).cast("string"), 2, "0"))
    path = shared_path(spark, "addresses")
    write_address_partitions(a, path)
    back = spark.read.schema(a.schema).parquet(path)
    return back.groupBy("voivodeship_code").agg(F.count(F.lit(1)).alias("records"))


@query(
    "incremental_ingest",
    """WITH rec AS (SELECT CAST(l_orderkey % 7 AS VARCHAR) AS dataset_key, l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey))
SELECT dataset_key, count(*) AS records, CASE WHEN dataset_key IN ('0', '1') THEN 'failed' ELSE 'published' END AS status, CASE dataset_key WHEN '0' THEN 'INVALID_CRS' WHEN '1' THEN 'OUTSIDE_POLAND' END AS error FROM rec GROUP BY ALL""",
)
def q_incremental_ingest(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    key = (F.col("l_orderkey") % 7).cast("string")
    r = li.select(
        key.alias("dataset_key"), F.lit("address").alias("record_type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("object_id"), F.when(key == "0", "EPSG:4326").otherwise("EPSG:2180").alias("crs"), F.col("l_partkey").cast("string").alias("street_id"),
        F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.when(key == "1", 2e6).otherwise(1.0).alias("max_x"), F.lit(1.0).alias("max_y"),
    )
    root = shared_path(spark, "landing")
    r.write.parquet(f"{root}/in")
    r = spark.read.schema(r.schema).parquet(f"{root}/in")
    streets = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("object_id"))
    manifest = r.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("expected"))
    incremental_ingest(spark, f"{root}/in", f"{root}/table", f"{root}/state", streets, manifest)
    runs = spark.read.parquet(f"{root}/table/runs")
    return runs.select("dataset_key", "records", "status", "error")


_LINES = "lines AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _lines(spark, sf_dir):
    first = F.min(F.struct("l_partkey", "l_suppkey")).alias("s")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "s.l_partkey", "s.l_suppkey")


@query(
    "publication_versions",
    f"""WITH {_LINES}
SELECT CAST(l_suppkey % 4 + 1 AS BIGINT) AS snapshot_id, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 1 THEN 'second' ELSE 'first' END AS edition, 'current:A0' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS dataset_key
FROM lines WHERE l_suppkey % 4 < 2 OR (l_suppkey % 4 = 2 AND l_linenumber < 3)""",
)
def publication_versions(spark, sf_dir):
    """Three snapshots, one of which is published anew; of the third, what came first stays as its second edition is wrong; a fourth never is right."""
    rows = _lines(spark, sf_dir).select((F.col("l_suppkey") % 4 + 1).alias("snapshot_id"), "l_orderkey", "l_linenumber")
    root = shared_path(spark, "publication")
    check = lambda df: df.filter("(snapshot_id = 4 OR (snapshot_id = 3 AND edition = 'second')) AND l_linenumber >= 3").select("snapshot_id", F.lit("LINE").alias("code"))

    def tables(report):
        layer = F.concat(F.lit("A0"), F.col("snapshot_id").cast("string"))
        return {"coverage": report.select(layer.alias("layer_id"), F.concat(F.lit("current:"), layer).alias("dataset_key"), F.lit(0).alias("archive_year"), F.lit("country").alias("scope_type"), F.lit("PL").alias("scope_code"), "snapshot_id", F.lit("complete").alias("completeness"))}

    publish_snapshots(rows.filter("snapshot_id <> 3 OR l_linenumber < 3").withColumn("edition", F.lit("first")), root, tables, check)
    publish_snapshots(rows.filter("snapshot_id IN (2, 3)").withColumn("edition", F.lit("second")), root, tables, check)
    return read_snapshots(spark, root).join(read_table(spark, root, "coverage").select("snapshot_id", "dataset_key"), "snapshot_id").select("snapshot_id", "l_orderkey", "l_linenumber", "edition", "dataset_key")


@query(
    "package_ingest",
    f"""WITH {_LINES}
SELECT CAST(l_orderkey % 5 AS VARCHAR) AS dataset_key, CAST(l_orderkey % 5 + 1 AS BIGINT) AS snapshot_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS object_id FROM lines WHERE l_orderkey % 5 NOT IN (3, 4)""",
)
def package_ingest(spark, sf_dir):
    """Datasets in three packages that land in three runs, some twice; one is wrong and one never whole."""
    key = (F.col("l_orderkey") % 5).cast("string")
    part = (F.col("l_linenumber") % 3).cast("string")
    r = _lines(spark, sf_dir).select(
        key.alias("dataset_key"), F.lit("address").alias("record_type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("object_id"), F.when(key == "3", "EPSG:4326").otherwise("EPSG:2180").alias("crs"), F.col("l_partkey").cast("string").alias("street_id"),
        F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(1.0).alias("max_x"), F.lit(1.0).alias("max_y"), F.concat_ws("/", key, part).alias("package_id"), part.alias("part"),
    )
    r, base = written(r, "records"), shared_path(spark, "packages")
    streets = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("object_id"))
    manifest = r.groupBy("dataset_key").agg((F.count(F.lit(1)) + F.when(F.first("dataset_key") == "4", 1).otherwise(0)).alias("expected")).select("dataset_key", "expected", (F.col("dataset_key").cast("bigint") + 1).alias("snapshot_id"), F.concat(F.lit("A0"), "dataset_key").alias("layer_id"))
    for now in ("part = '0'", "part = '1' OR (part = '0' AND dataset_key = '2')", "part = '2' OR (part = '1' AND dataset_key = '1')"):
        r.filter(now).drop("part").repartition("package_id").write.mode("append").parquet(f"{base}/in")
        ingest_packages(spark, f"{base}/in", f"{base}/root", f"{base}/state", streets, manifest)
    return read_snapshots(spark, f"{base}/root").select("dataset_key", "snapshot_id", "object_id")
