"""What is installed, and what of a request is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requested_pairs(layers: DataFrame, scopes: DataFrame) -> DataFrame:
    """All (layer_id, scope) pairs of two small dimension tables."""
    return layers.select("layer_id").distinct().crossJoin(scopes.select("scope").distinct())


def merge_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("layer_id", "scope").unionByName(b.select("layer_id", "scope")).dropDuplicates()


def missing_pairs(requested: DataFrame, installed: DataFrame) -> DataFrame:
    """Requested but not installed; labelled by scope alone where only one layer is asked for."""
    gone = requested.join(installed.select("layer_id", "scope").distinct(), ["layer_id", "scope"], "left_anti")
    one = requested.agg((F.countDistinct("layer_id") == 1).alias("one"))
    return gone.crossJoin(F.broadcast(one)).select("layer_id", "scope", F.when(F.col("one"), F.col("scope")).otherwise(F.concat_ws(":", "layer_id", "scope")).alias("label"))


def coverage_with_provenance(
    coverage: DataFrame, snapshots: DataFrame, complete_only: bool = False, layer_ids: list[str] | None = None, dataset_key: str | None = None, snapshot_id: int | None = None, archive_year: int | None = None
) -> DataFrame:
    """Rows of coverage with when and from what their snapshot was made; a filter that is None asks nothing."""
    c = coverage.filter("completeness = 'complete'") if complete_only else coverage
    c = c if layer_ids is None else c.filter(F.col("layer_id").isin(layer_ids))
    for name, value in (("dataset_key", dataset_key), ("snapshot_id", snapshot_id), ("archive_year", archive_year)):
        c = c if value is None else c.filter(F.col(name) == F.lit(value))
    return c.join(snapshots.select(F.col("id").alias("snapshot_id"), "downloaded_at", "etag"), "snapshot_id")


def coverage_summary(requested: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per request: pairs asked for, installed, missing scopes, state and the last download.

    ``requested``: request_id, layer_id, scope. Complete only if something was asked for and nothing is
    missing; unknown if no row of coverage belongs to the request at all.
    """
    have = coverage.groupBy("layer_id", "scope").agg(F.bool_or(F.col("completeness") == "complete").alias("done"), F.max(F.when(F.col("completeness") == "complete", F.col("downloaded_at"))).alias("at"))
    j = requested.distinct().join(have, ["layer_id", "scope"], "left").withColumn("ok", F.coalesce("done", F.lit(False)))
    s = j.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if("ok").alias("installed"), F.count_if(F.col("done").isNotNull()).alias("known"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("scope")))), ",").alias("missing_scopes"), F.max("at").alias("synced_at"),
    )
    state = F.when(F.col("known") == 0, "unknown").when(F.col("installed") == F.col("asked"), "complete").otherwise("partial")
    return s.withColumn("state", state).drop("known")


def source_status(coverage: DataFrame, catalog_pairs: DataFrame) -> DataFrame:
    """Installed layers and pairs, and whether the whole catalog is complete."""
    done = coverage.filter("completeness = 'complete'").select("layer_id", "scope").distinct()
    short = catalog_pairs.join(done, ["layer_id", "scope"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return done.agg(F.countDistinct("layer_id").alias("layers"), F.count(F.lit(1)).alias("pairs")).crossJoin(F.broadcast(short)).withColumn("complete", F.col("missing") == 0)


#: The layers that addresses and streets are counted as.
ADDRESS_LAYER, STREET_LAYER = "A07", "A08"


def layer_counts(areas: DataFrame, current: DataFrame, addresses: DataFrame | None = None, streets: DataFrame | None = None) -> DataFrame:
    """Records of each layer: areas of its current snapshots if it has any, else of all; addresses and streets of all shards."""
    has = current.select("layer_id").distinct().withColumn("_has", F.lit(True))
    live = areas.join(current.withColumn("_cur", F.lit(True)), ["layer_id", "snapshot_id"], "left").join(has, "layer_id", "left")
    counts = live.filter("_cur OR _has IS NULL").groupBy("layer_id").agg(F.count(F.lit(1)).alias("records"))
    for table, layer in ((addresses, ADDRESS_LAYER), (streets, STREET_LAYER)):
        if table is not None:
            counts = counts.unionByName(table.agg(F.count(F.lit(1)).alias("records")).select(F.lit(layer).alias("layer_id"), "records"))
    return counts


def list_layers(layers: DataFrame, counts: DataFrame, coverage: DataFrame) -> DataFrame:
    """The catalog with availability, counts and complete scopes."""
    held = coverage.groupBy("layer_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("completeness") == "complete", F.col("scope")))), ",").alias("scopes"))
    j = layers.join(counts, "layer_id", "left").join(held, "layer_id", "left").withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))
    available = F.when(F.col("scopes").isNull(), F.col("records") > 0).otherwise(F.col("scopes") != "")
    return j.withColumn("available", available).withColumn("scopes", F.coalesce("scopes", F.lit("")))


def coverage_report(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count_if("available").alias("installed"), F.count(F.lit(1)).alias("total"))


def distinct_layers(areas: DataFrame) -> DataFrame:
    return areas.select("layer_id").distinct()
