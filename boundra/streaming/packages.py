"""Datasets that land in several packages: counted in keyed state across micro-batches, published when they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boundra.operators.quality import validate_dataset
from boundra.sources.publication import publish_snapshots
from boundra.sources.storage import written
from boundra.streaming.ingest import RECORD

PACKAGE = f"{RECORD}, package_id string"
_STATE = "packages array<string>, files array<string>, records bigint, done boolean"
_OUTCOME = "dataset_key string, outcome string, records bigint, files array<string>"


def _watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    """A dataset's packages so far. Rows: package_id, file, n, expected - n records of a package in a file."""
    if state.hasTimedOut:
        _, files, records, _ = state.get
        state.remove()
        yield pd.DataFrame([(key[0], "expired", records, list(files))], columns=["dataset_key", "outcome", "records", "files"])
        return
    packages, files, records, done = state.get if state.exists else ([], [], 0, False)
    packages, files = list(packages), list(files)
    found: dict[tuple[str, str], int] = {}
    expected = None
    for part in rows:
        expected = int(part["expected"].iloc[0])
        for (package, file), n in part.groupby(["package_id", "file"])["n"].sum().items():
            found[package, file] = found.get((package, file), 0) + int(n)
    for (package, file), n in sorted(found.items()):
        if package not in packages and not done:  # one that lands again counts once
            packages.append(package)
            files.append(f"{package}\x01{file}")
            records += n
    whole = not done and records >= expected
    state.update((packages, [] if whole else files, records, done or whole))
    if whole:
        yield pd.DataFrame([(key[0], "whole", records, files)], columns=["dataset_key", "outcome", "records", "files"])
    elif not done:
        state.setTimeoutDuration(timeout_ms)


def ingest_packages(spark: SparkSession, landing: str, root: str, checkpoint: str, streets: DataFrame, manifest: DataFrame, timeout_ms: int = 3_600_000, name: str = "packages") -> None:
    """Take in the packages (Parquet of PACKAGE rows) that are new under ``landing``, and return when that is done.

    ``manifest``: dataset_key, expected records, snapshot_id, layer_id. Packages of a dataset may land in any order and in many
    runs; one that lands twice counts once. When all expected records are there, they are read back from the landing
    folder, checked, and published under ``root`` as the dataset's snapshot, with its coverage and a run row, by one change of a pointer. A dataset of which
    nothing lands for ``timeout_ms`` before it is whole is given up with a run row EXPIRED, by the next run in which anything lands; what lands later begins anew. A
    micro-batch that is run again publishes nothing twice. The landing folder keeps its files.
    """
    known = written(manifest.select("dataset_key", "expected", "snapshot_id", "layer_id"), "known")  # used many times in each batch

    def publish(outcomes: DataFrame, batch_id: int) -> None:
        outcomes = outcomes.persist()
        try:
            whole = outcomes.filter("outcome = 'whole'")
            lost = outcomes.filter("outcome = 'expired'").join(known, "dataset_key").select("dataset_key", "snapshot_id", "layer_id", "records", F.lit("EXPIRED").alias("error"))
            taken = whole.select("dataset_key", F.explode("files").alias("f")).select("dataset_key", F.substring_index("f", "\x01", 1).alias("package_id"), F.substring_index("f", "\x01", -1).alias("_file"))
            taken = written(taken, "taken")
            landed = spark.read.schema(PACKAGE).parquet(landing).withColumn("_file", F.col("_metadata.file_name"))
            rows = landed.join(taken, ["dataset_key", "package_id", "_file"], "left_semi").drop("_file").join(known.select("dataset_key", "snapshot_id"), "dataset_key")
            keys = whole.select("dataset_key").distinct()

            def check(staged: DataFrame) -> DataFrame:
                wanted = known.join(keys, "dataset_key", "left_semi").select("dataset_key", "expected")
                bad = validate_dataset(staged.select("dataset_key", "record_type", "object_id", "crs", "street_id", "min_x", "min_y", "max_x", "max_y"), streets, wanted)
                return bad.groupBy("dataset_key").agg(F.min_by("code", "severity").alias("code")).join(known, "dataset_key").select("snapshot_id", "code")

            def tables(report: DataFrame) -> dict[str, DataFrame]:
                done = report.join(known, "snapshot_id").select("dataset_key", "snapshot_id", "layer_id", "records", "error")
                runs = done.unionByName(lost).select(F.concat(F.lit(f"{name}-{batch_id}-"), "dataset_key").alias("run_id"), "dataset_key", "records", F.when(F.col("error").isNull(), "published").otherwise("failed").alias("status"), "error")
                coverage = done.filter("error IS NULL").select("layer_id", "dataset_key", F.lit(0).alias("archive_year"), F.lit("country").alias("scope_type"), F.lit("PL").alias("scope_code"), "snapshot_id", F.lit("complete").alias("completeness"))
                return {"runs": runs, "coverage": coverage}

            if not outcomes.isEmpty():
                publish_snapshots(rows, root, tables, check, (name, batch_id))
        finally:
            outcomes.unpersist()

    rows = spark.readStream.schema(PACKAGE).parquet(landing).select("dataset_key", F.coalesce("package_id", F.lit("")).alias("package_id"), F.col("_metadata.file_name").alias("file"), F.lit(1).alias("n"))
    counted = rows.join(F.broadcast(known.select("dataset_key", "expected")), "dataset_key").groupBy("dataset_key").applyInPandasWithState(
        lambda key, parts, state: _watch(key, parts, state, timeout_ms), _OUTCOME, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    # a timeout by the clock would have it run batches without data for ever; those are seen when something lands again
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        counted.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
