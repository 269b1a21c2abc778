"""Address packages in GML: features by Spark's XML reader, mapped to canonical addresses and streets.

Both layouts, of 2012 and of 2021, share one all-text schema, so no code loses its leading zeros. Rows
that break the XML, and features that lack a required field, come out in quarantine with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "struct<AD_IdentyfikatorIIP:struct<przestrzenNazw:string,lokalnyId:string,wersjaId:string>,BT_Identyfikator:struct<przestrzenNazw:string,lokalnyId:string,wersjaId:string>>"
_LIFE = "struct<AD_CyklZycia:struct<poczatekWersjiObiektu:string>,BT_CyklZyciaInfo:struct<poczatekWersjiObiektu:string>>"
_POINT = "struct<Point:struct<pos:string,_srsName:string>>"
_LINE = "struct<LineString:struct<posList:string,_srsName:string>>"
_NAME = "struct<AD_NazwaUlicy:struct<nazwaGlownaCzesc:string,przedrostek1Czesc:string>>"
ADDRESS_SCHEMA = f"_id string, idIIP {_ID}, cyklZycia {_LIFE}, waznyOd string, dataNadania string, numerPorzadkowy string, kodPocztowy string, pozycja {_POINT}, georeferencja {_POINT}, miejscowosc string, ulica string, _corrupt_record string"
STREET_SCHEMA = f"_id string, idIIP {_ID}, cyklZycia {_LIFE}, waznyOd string, dataNadania string, nazwa {_NAME}, nazwaPelna string, TERYTNazwa1 string, identyfikatorULIC string, idTERYT string, typ string, rodzaj string, geometria {_LINE}, _corrupt_record string"
YEARS = ("2012", "2021")


def read_features(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Features with their file and its version year, taken from the file's namespace."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").option("ignoreNamespace", "true").option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    year = F.regexp_extract("value", r"urn:gugik:emuia:[^\"' ]*(20[0-9]{2})", 1)
    years = lines.filter(F.col("value").contains("urn:gugik:emuia:")).select("file", year.alias("year")).filter("year <> ''").groupBy("file").agg(F.min("year").alias("year"))
    return rows.join(F.broadcast(years), "file", "left")


def _either(base: str, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(f"{base}.{p}" if base else p)), F.lit("")) for p in paths])


def map_address_points(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical addresses, and the features that lack something."""
    xy = F.split(F.trim(F.coalesce(F.col("pozycja.Point.pos"), F.col("georeferencja.Point.pos"))), r"\s+")
    made = features.select(
        "file", "year", _either("idIIP", "AD_IdentyfikatorIIP.lokalnyId", "BT_Identyfikator.lokalnyId").alias("object_id"), _either("idIIP", "AD_IdentyfikatorIIP.przestrzenNazw", "BT_Identyfikator.przestrzenNazw").alias("namespace"),
        _either("", "miejscowosc").alias("locality_name"), _either("", "ulica").alias("street_name"), _either("", "numerPorzadkowy").alias("building_number"), F.regexp_replace("kodPocztowy", "-", "").alias("postal_code"),
        F.get(xy, 0).try_cast("double").alias("x"), F.get(xy, 1).try_cast("double").alias("y"), F.when(F.col("year") == "2012", F.col("waznyOd")).otherwise(F.col("dataNadania")).alias("valid_from"),
        _either("cyklZycia", "AD_CyklZycia.poczatekWersjiObiektu", "BT_CyklZyciaInfo.poczatekWersjiObiektu").alias("version_from"), "_corrupt_record",
    )
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "BROKEN_XML").when(F.col("year").isNull() | ~F.col("year").isin(*YEARS), "UNKNOWN_VERSION").when(F.col("object_id").isNull(), "NO_LOCAL_ID")
        .when(F.col("namespace").isNull(), "NO_NAMESPACE").when(F.col("building_number").isNull(), "NO_NUMBER").when(F.col("x").isNull() | F.col("y").isNull(), "NO_POINT")
    )
    marked = made.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason", "_corrupt_record"), marked.filter("reason IS NOT NULL").select("file", "object_id", "reason")


def map_streets(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical streets, and the features that lack something. A line has an even count of at least four numbers."""
    old, new = _either("", "nazwa.AD_NazwaUlicy.nazwaGlownaCzesc"), _either("", "TERYTNazwa1")
    numbers = F.transform(F.split(F.trim(F.col("geometria.LineString.posList")), r"\s+"), lambda v: v.try_cast("double"))
    ring = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) / 2 - 1, F.lit(0)).cast("int")), lambda k: F.struct(F.get(numbers, 2 * k).alias("x"), F.get(numbers, 2 * k + 1).alias("y")))
    good = (F.size(numbers) >= 4) & (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda v: v.isNotNull())
    full = F.coalesce(_either("", "nazwaPelna"), old, new)
    made = features.select(
        "file", "year", _either("idIIP", "AD_IdentyfikatorIIP.lokalnyId", "BT_Identyfikator.lokalnyId").alias("object_id"), F.coalesce(old, new, full).alias("name"), full.alias("full_name"),
        F.when(F.col("year") == "2012", F.col("idTERYT")).otherwise(F.col("identyfikatorULIC")).alias("ulic_id"), F.when(F.col("year") == "2012", F.col("typ")).otherwise(F.col("rodzaj")).alias("kind"),
        F.when(good, F.struct(F.lit("LineString").alias("kind"), F.array(F.array(ring)).alias("parts"))).alias("geom"), "_corrupt_record",
    )
    reason = F.when(F.col("_corrupt_record").isNotNull(), "BROKEN_XML").when(F.col("year").isNull() | ~F.col("year").isin(*YEARS), "UNKNOWN_VERSION").when(F.col("object_id").isNull(), "NO_LOCAL_ID").when(F.col("name").isNull(), "NO_NAME").when(F.col("geom").isNull(), "BAD_LINE")
    marked = made.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason", "_corrupt_record"), marked.filter("reason IS NOT NULL").select("file", "object_id", "reason")


def read_boundary_layer(spark: SparkSession, path: str, layer_id: str, row_tag: str) -> DataFrame:
    """Code, name and box of boundary features; pairs that aren't finite numbers are left out."""
    schema = "JPT_KOD_JE string, JPT_NAZWA_ string, WAZNY_OD string, IIP_IDENTY string, REGON string, msGeometry struct<Polygon:struct<exterior:struct<LinearRing:struct<posList:string>>>,Point:struct<pos:string>>"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    text = F.coalesce("msGeometry.Polygon.exterior.LinearRing.posList", "msGeometry.Point.pos", F.lit(""))
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))
    at = lambda odd: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2) - 1, F.lit(0)).cast("int")), lambda k: F.when(F.get(numbers, 2 * k).isNotNull() & F.get(numbers, 2 * k + 1).isNotNull(), F.get(numbers, 2 * k + odd))), lambda v: v.isNotNull())
    return raw.select(F.lit(layer_id).alias("layer_id"), F.col("JPT_KOD_JE").alias("code"), F.col("JPT_NAZWA_").alias("name"), F.col("WAZNY_OD").alias("valid_from"), F.col("IIP_IDENTY").alias("iip_id"), F.array_min(at(0)).alias("min_x"), F.array_min(at(1)).alias("min_y"), F.array_max(at(0)).alias("max_x"), F.array_max(at(1)).alias("max_y"))


#: Source fields of boundary layers and what they become, first non-empty one.
FIELDS = {
    "code": ["JPT_KOD_JE", "TERYT"], "name": ["JPT_NAZWA_", "FULL_NAME"], "valid_from": ["WAZNY_OD"], "valid_to": ["WAZNY_DO"], "version_from": ["WERSJA_OD"], "version_to": ["WERSJA_DO"],
    "iip_id": ["IIP_IDENTY"], "regon": ["REGON"], "explicit_id": ["GRA_ID"],
}


def map_boundary_fields(raw: DataFrame) -> DataFrame:
    """Area columns from source fields; all others become source properties.

    The object id is the explicit one, else the IIP id, else a hash of the stable fields.
    """
    have = {c.upper(): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n]}`").cast("string")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    used = {n for v in FIELDS.values() for n in v}
    rest = [c for u, c in have.items() if u not in used]
    cols = {k: pick(v) for k, v in FIELDS.items()}
    made = raw.select(*[c.alias(k) for k, c in cols.items()], (F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")).alias("properties"))
    stable = F.sha2(F.concat_ws("\u0001", *[F.coalesce(k, F.lit("")) for k in ("code", "name", "valid_from", "regon")], F.to_json("properties")), 256)
    return made.withColumn("object_id", F.coalesce("explicit_id", "iip_id", stable)).drop("explicit_id")


def read_universal_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of the ``;`` file: code, locality and point from the piped field, rows without a finite point dropped."""
    raw = spark.read.option("sep", ";").option("header", "true").option("quote", "").option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    p = F.split(F.col("adruni"), r"\|")
    x, y = F.get(p, 5).try_cast("double"), F.get(p, 6).try_cast("double")
    return raw.select("*", F.get(p, 0).alias("municipality_code"), F.get(p, 1).alias("locality_name"), F.get(p, 2).alias("street_name"), F.get(p, 3).alias("building_number"), F.get(p, 4).alias("postal_code"), x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < 1e308 AND abs(y) < 1e308").drop("adruni")
