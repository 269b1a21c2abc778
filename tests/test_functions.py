"""Goldens of the scalar functions and geometry expressions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from boundra.functions import crs, geometry, ids, text
from boundra.functions.sql import register_functions
from boundra.sources import wkb


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,norm", [(" Ul. Żurawia 12 A ", "ulica zurawia 12a"), ("al. Jana Pawła II 12 / 14", "aleja jana pawla ii 12/14"), ("00-503", "00503"), ("pl. Centralny", "plac centralny"), ("", "")])
def test_normalize_polish(spark, raw, norm):
    assert one(spark, text.normalize_polish(F.lit(raw))) == norm
    register_functions(spark)
    assert spark.createDataFrame([(raw,)], "t string").selectExpr("normalize_polish(t) v").first().v == norm


def test_normalize_area(spark):
    assert one(spark, text.normalize_area(F.lit("Łódź-Górna"))) == "lodz gorna"


@pytest.mark.parametrize("query,mode", [("zurawia", "exact"), ("zur", "prefix"), ("raw", "contains"), ("zurawya", "fuzzy"), ("xyz", "none"), ("", "none")])
def test_match_modes(spark, query, mode):
    assert one(spark, text.classify_match(F.lit(query), F.lit("zurawia")))["mode"] == mode


def test_street_kind(spark):
    assert one(spark, text.remove_street_kind(F.lit("warszawa ulica zurawia 12a"))) == "warszawa zurawia 12a"
    assert one(spark, text.format_address(F.lit("Kraków"), F.lit("Plac Centralny"), F.lit("1"), F.lit(None))) == "Kraków Plac Centralny 1"
    assert one(spark, text.format_address(F.lit("Wieliszew"), F.lit(None), F.lit("12/14"), F.lit(""))) == "Wieliszew 12/14"


def test_projection_goldens(spark):
    g = one(spark, crs.to_4326(F.lit(637807.0), F.lit(486708.0)))
    assert abs(g["lon"] - 21.018397622768067) < 1e-9 and abs(g["lat"] - 52.229151521131236) < 1e-9
    m = one(spark, crs.to_2180(F.lit(21.015), F.lit(52.229)))
    assert abs(m["x"] - 637575.5181246095) < 1e-4 and abs(m["y"] - 486684.6981824972) < 1e-4
    assert one(spark, crs.to_2180(F.lit(200.0), F.lit(52.0))) is None


SQUARE = ("Polygon", [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]])
LINE = ("LineString", [[[(0, 0), (2, 0), (2, 2)]]])


def shapes(spark, *geoms):
    rows = [((k, [[[(float(x), float(y)) for x, y in r] for r in p] for p in parts]),) for k, parts in geoms]
    return spark.createDataFrame(rows, f"geom {geometry.GEOM_TYPE}")


@pytest.mark.parametrize("x,y,inside", [(0, 0, True), (4, 2, True), (1, 2, True), (3, 3, True), (2, 2, False), (5, 5, False), (0.5, 0.5, True), (-1, 2, False)])
def test_point_covered(spark, x, y, inside):
    row = shapes(spark, SQUARE).select(geometry.point_covered(F.lit(float(x)), F.lit(float(y)), geometry.edges(F.col("geom"))).alias("v")).first()
    assert row.v is inside


def test_centroids(spark):
    rows = shapes(spark, SQUARE, LINE, ("MultiPoint", [[[(0, 0)]], [[(2, 4)]]])).select(geometry.centroid(F.col("geom")).alias("c"), geometry.vertex_count(F.col("geom")).alias("n")).collect()
    assert [(r.c["x"], r.c["y"], r.n) for r in rows] == [(2.0, 2.0, 10), (1.5, 0.5, 3), (1.0, 2.0, 2)]


def test_geometry_errors(spark):
    bad = [("Curve", []), ("Polygon", []), ("LineString", [[[(0, 0)]]]), ("Polygon", [[[(0, 0), (1, 0), (1, 1), (0, 1)]]]), ("Polygon", [[[(0, 0), (1, 0), (0, 0)]]]), ("Point", [[[(float("nan"), 0)]]])]
    rows = shapes(spark, SQUARE, *bad).select(geometry.validate_geometry(F.col("geom")).alias("e")).collect()
    assert [r.e for r in rows] == [None, "UNKNOWN_KIND", "EMPTY", "LINE_TOO_SHORT", "RING_NOT_CLOSED", "RING_TOO_SHORT", "NOT_FINITE"]


def test_wkb(spark):
    df = shapes(spark, SQUARE, LINE, ("MultiPolygon", SQUARE[1] * 2), ("Point", [[[(1, 2)]]]), ("MultiPoint", [[[(1, 2)]], [[(3, 4)]]]))
    back = wkb.decode_wkb(wkb.encode_wkb(df), "wkb", "back").collect()
    assert all(r.geom == r.back and r.geom_error is None if "geom_error" in r else r.geom == r.back for r in back)
    big = bytes([0]) + (1).to_bytes(4, "big") + b"\x3f\xf0" + b"\0" * 6 + b"\x40" + b"\0" * 7
    assert wkb.parse(big) == ("Point", [[[{"x": 1.0, "y": 2.0}]]])
    for data, reason in ((b"\x01\x01\0\0\0", "TRUNCATED"), (b"\x05\x01\0\0\0", "BYTE_ORDER"), (b"\x01\x09\0\0\0", "UNKNOWN_TYPE"), (big + b"x", "TRAILING_BYTES"), (b"", "TRUNCATED")):
        with pytest.raises(wkb.WkbError, match=reason):
            wkb.parse(data)


def test_ids(spark):
    made = ids.encode_id(layerId=F.lit("A03"), objectId=F.lit("gmina?>"), snapshotId=F.lit(1))
    back = one(spark, ids.decode_id(made, "layerId string, objectId string, snapshotId long"))
    assert (back["layerId"], back["objectId"], back["snapshotId"]) == ("A03", "gmina?>", 1)
    assert one(spark, ids.decode_id(F.lit("no id!"), "layerId string")) is None
    assert one(spark, ids.parse_properties(F.lit("[1]"))) == {} and one(spark, ids.parse_properties(F.lit('{"a": 1}'))) == {"a": "1"}


@pytest.mark.parametrize("code,kind", [("14", "voivodeship"), ("1465", "county"), ("1465011", "municipality"), ("1465019", None), ("99", None), ("146", None)])
def test_scope(spark, code, kind):
    found = one(spark, ids.parse_scope(F.lit(code)))
    assert (found and found["type"]) == kind


def test_whole_texts_are_searched(spark, tmp_path):
    rng = random.Random(5)
    words = "an and ant be bee cat do dog eel elk fox".split()
    texts = {k: " ".join(rng.choices(words, k=rng.randint(3, 40))) for k in range(60)}
    items = {1: "an and fox", 2: "an and eel, DOG fox", 3: "an and nothing", 4: "be do do cat e"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = {k: t.split() for k, t in texts.items()}
    mean = sum(map(len, held.values())) / len(held)
    want = []
    for item, text in items.items():
        asked = set(re.findall(r"\w+", text.lower()))
        hits = {w: {k: n for k, t in held.items() if (n := sum(x.startswith(w) for x in t))} for w in asked}
        scored = []
        for k, t in held.items():
            if all(k in hits[w] for w in asked):
                idf = {w: math.log((60 - len(hits[w]) + 0.5) / (len(hits[w]) + 0.5)) for w in asked}
                s = sum((idf[w] if idf[w] > 0 else 1e-6) * hits[w][k] * 2.2 / (hits[w][k] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in asked)
                scored.append((round(-s, 9), k))
        want += [(item, k, pytest.approx(s, abs=2e-6), r) for r, (s, k) in enumerate(sorted(scored)[:10], 1)]
    found = sorted(tuple(x) for x in __spark_entry__.queries()["bm25_topk_whole_texts"](spark, str(tmp_path)).select("request_id", "doc_id", "bm25", "rank").collect())
    assert sorted(found, key=lambda x: (x[0], x[3])) == want and {x[0] for x in found} == {1, 2, 4}
