"""Planning and deciding synchronisation for tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.functions.ids import VOIVODESHIPS, parse_scope
from boundra.operators.catalog import ARCHIVE_YEARS, LAYERS, layers_table, profiles_table

MIB, RESERVE = 1024 * 1024, 256 * 1024 * 1024


def plan_targets(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Targets of each plan (plan_id, profile, layer_ids, scopes, archive_year, mode), or one row with its refusal.

    Boundary layers take the whole country; address layers the scopes given, or all voivodeships.
    """
    layers = layers_table(spark)
    profile = profiles_table(spark).groupBy("profile").agg(F.collect_list("layer_id").alias("of_profile"))
    r = requests.join(F.broadcast(profile), "profile", "left").withColumn("ids", F.array_distinct(F.coalesce("layer_ids", "of_profile")))
    every = F.array(*[F.lit(x) for x, _, _ in LAYERS])
    address = F.array(F.lit("A07"), F.lit("A08"))
    history = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("A0"), k.cast("string")))
    years = F.array(*[F.lit(x) for x in ARCHIVE_YEARS])
    scoped = F.coalesce(F.size("scopes"), F.lit(0)) > 0
    archive = F.col("archive_year").isNotNull()
    status = (
        F.when(~F.coalesce(F.col("mode"), F.lit("")).isin("missing", "stale", "force"), "INVALID_MODE")
        .when(F.col("ids").isNull(), "INVALID_PROFILE")
        .when(F.size(F.array_except("ids", every)) > 0, "INVALID_LAYER")
        .when(scoped & F.exists(F.coalesce("scopes", F.array().cast("array<string>")), lambda s: parse_scope(s).isNull()), "INVALID_TERYT")
        .when((F.col("profile") == "administrative-history") & ~archive, "MISSING_ARCHIVE_YEAR")
        .when(archive & (~F.array_contains(years, F.col("archive_year")) | (F.size(F.array_except("ids", history)) > 0) | scoped), "ARCHIVE_NOT_AVAILABLE")
        .when(scoped & (F.size(F.array_except("ids", address)) > 0), "INVALID_TERYT")
        .otherwise("OK")
    )
    r = r.withColumn("status", status)
    one = r.filter("status = 'OK'").select("plan_id", "archive_year", F.array_distinct("scopes").alias("scopes"), F.explode("ids").alias("layer_id")).join(F.broadcast(layers.select("layer_id", "channel")), "layer_id")
    country = F.array(F.struct(F.lit("country").alias("type"), F.lit("PL").alias("code")))
    all_codes = F.array(*[F.struct(F.lit("voivodeship").alias("type"), F.lit(x).alias("code")) for x in VOIVODESHIPS])
    given = F.when(F.size("scopes") > 0, F.transform("scopes", lambda s: parse_scope(s)))
    scopes = F.when(F.col("channel") == "wfs", country).otherwise(F.coalesce(given, all_codes))
    t = one.withColumn("scope", F.explode(scopes))
    factor = F.element_at(F.create_map(F.lit("country"), F.lit(16.0), F.lit("voivodeship"), F.lit(1.0), F.lit("county"), F.lit(0.2), F.lit("municipality"), F.lit(0.04)), F.col("scope.type"))
    wfs = F.col("channel") == "wfs"
    down = F.ceil(F.when(wfs, 8.0 * MIB).otherwise(220.0 * MIB) * factor)
    key = F.when(F.col("archive_year").isNull(), F.concat(F.lit("current:"), "layer_id")).otherwise(F.concat(F.lit("archive:"), F.col("archive_year").cast("string"), F.lit(":"), "layer_id"))
    made = t.select("plan_id", "layer_id", key.alias("dataset_key"), F.concat_ws(":", "scope.type", "scope.code").alias("scope"), down.alias("download_bytes"), F.ceil(down * F.when(wfs, 2.5).otherwise(4.0)).alias("disk_bytes"), F.lit("OK").alias("status"))
    none = F.lit(None)
    refused = r.filter("status <> 'OK'").select("plan_id", none.cast("string").alias("layer_id"), none.cast("string").alias("dataset_key"), none.cast("string").alias("scope"), none.cast("bigint").alias("download_bytes"), none.cast("bigint").alias("disk_bytes"), "status")
    return made.unionByName(refused)


def plan_costs(targets: DataFrame, free_bytes: int) -> DataFrame:
    """Bytes of each plan, and whether the disk holds them besides a reserve."""
    sums = targets.groupBy("plan_id").agg(F.sum("download_bytes").alias("download_bytes"), F.sum("disk_bytes").alias("disk_bytes"))
    return sums.withColumn("fits", F.col("disk_bytes") + RESERVE <= free_bytes)


def probe_status(changed_fingerprint: Column, changed_date: Column, changed_tags: Column, known: Column) -> Column:
    return F.when(~known, "available").when(changed_fingerprint, "schema_changed").when(changed_date | changed_tags, "changed").otherwise("available")


def classify_probes(snapshots: DataFrame, probes: DataFrame) -> DataFrame:
    """Status of each probe (dataset_key, scope, p_fingerprint, p_state_date, p_etag, p_modified) against its snapshot."""
    j = probes.join(snapshots.withColumn("_known", F.lit(True)), ["dataset_key", "scope"], "left")
    differs = lambda p, s: F.coalesce(F.col(p) != "", F.lit(False)) & ~F.col(p).eqNullSafe(F.col(s))
    status = probe_status(differs("p_fingerprint", "fingerprint"), differs("p_state_date", "state_date"), differs("p_etag", "etag") | differs("p_modified", "modified"), F.coalesce("_known", F.lit(False)))
    return j.select("dataset_key", "scope", status.alias("probe_status"))


def sync_decisions(targets: DataFrame, mode: str, now: Column, max_age_hours: int = 24) -> DataFrame:
    """synchronise, unchanged or blocked for targets with known (has a snapshot), archive, checked_at, probe_status.

    A check in the future counts as stale. An archive isn't probed, and never loaded twice.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    fresh = F.coalesce((age >= 0) & (age < max_age_hours * 3600), F.lit(False))
    known, archive, probe = F.col("known"), F.col("archive"), F.coalesce("probe_status", F.lit("available"))
    blocked = ~archive & ~probe.isin("available", "changed") & ~(F.lit(mode == "force") & (probe == "schema_changed"))
    wanted = F.lit(True) if mode == "force" else ~known if mode == "missing" else ~known | (~archive & (probe == "changed")) | ~fresh
    first = (known & F.lit(mode == "missing"))
    return targets.withColumn("decision", F.when(first, "unchanged").when(blocked, "blocked").when(archive & known, "unchanged").when(wanted, "synchronise").otherwise("unchanged"))


def run_report(results: DataFrame) -> DataFrame:
    """complete, partial or failed for each run from its targets' statuses."""
    r = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("status") == "failed").alias("failed"))
    return r.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("failed") == F.col("targets"), "failed").otherwise("partial"))
