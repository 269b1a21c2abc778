"""Lookups by opaque id, and public summaries of areas, addresses and streets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.functions.ids import decode_id, encode_id, parse_properties


def lookup(requests: DataFrame, table: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Every request (with ``id``) with its row of ``table`` and a status: found, not_found or invalid_id."""
    asked = requests.withColumn("_id", decode_id(F.col("id"), schema))
    for k in keys:
        asked = asked.withColumn(f"_{k}", F.col(f"_id.{k}"))
    valid = F.lit(True)
    for k in keys:
        valid = valid & F.col(f"_{k}").isNotNull()
    held = table.withColumn("_held", F.lit(True))
    on = [F.col(f"_{k}") == F.col(k) for k in keys]
    found = asked.join(held, on, "left")
    status = F.when(~valid, "invalid_id").when(F.col("_held"), "found").otherwise("not_found")
    return found.withColumn("status", status).drop("_held", "_id", *[f"_{k}" for k in keys])


def restore_rank_order(ranked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Full rows of the ranked keys; the rank column goes along, and orders each request."""
    return ranked.join(table, keys).orderBy("request_id", "rank")


def area_summary(areas: DataFrame, layers: DataFrame) -> DataFrame:
    """What is shown of an area: never its geometry."""
    a = areas.join(F.broadcast(layers.select("layer_id", F.col("title").alias("layer_title"), "category")), "layer_id", "left")
    return a.select(
        encode_id(layerId=F.col("layer_id"), objectId=F.col("object_id"), snapshotId=F.col("snapshot_id")).alias("id"), "layer_id", "layer_title", "category", "object_id", "snapshot_id", "name", "code", "iip_id", "regon",
        "valid_from", "valid_to", F.struct("min_x", "min_y", "max_x", "max_y").alias("bbox"), F.when(F.col("centroid_x").isNotNull(), F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))).alias("centroid"),
        parse_properties(F.col("source_properties_json")).alias("properties"),
    )


def address_summary(addresses: DataFrame) -> DataFrame:
    """What is shown of an address point; the postal code comes from the register, not from the post."""
    return addresses.select(
        encode_id(voivodeshipCode=F.col("voivodeship_code"), objectId=F.col("object_id")).alias("id"),
        F.when(F.col("street_id").isNotNull(), encode_id(voivodeshipCode=F.col("voivodeship_code"), objectId=F.col("street_id"))).alias("street_id"),
        "voivodeship_code", "object_id", "iip_id", "municipality_code", "locality_id", "locality_name", "street_name", "building_number", "postal_code",
        F.struct("x", "y").alias("point"), "valid_from", "version_from", "source_scope", F.lit("postal code as in the register").alias("postal_note"), parse_properties(F.col("source_properties_json")).alias("properties"),
    )


def street_summary(streets: DataFrame) -> DataFrame:
    return streets.select(
        encode_id(voivodeshipCode=F.col("voivodeship_code"), objectId=F.col("object_id")).alias("id"), "voivodeship_code", "object_id", "iip_id", "municipality_code", "locality_id", "name", "normalized_name",
        F.struct("min_x", "min_y", "max_x", "max_y").alias("bbox"),
    )
