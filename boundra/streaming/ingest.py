"""Incremental ingest: newly landed packages are validated and published one by one, failures apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.operators.quality import validate_dataset
from boundra.sources.storage import written

RECORD = "dataset_key string, record_type string, object_id string, crs string, street_id string, min_x double, min_y double, max_x double, max_y double"


def incremental_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, streets: DataFrame, manifest: DataFrame) -> None:
    """Take in everything new under ``landing`` (Parquet of RECORD rows) and return when it is done.

    Each micro-batch is validated by dataset. Datasets without violations are written under
    ``table``/data/batch=<id>, all get a row in ``table``/runs/batch=<id>. A batch that is run again
    overwrites its own folders, so a restart repeats nothing.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            keys = batch.select("dataset_key").distinct()
            bad = validate_dataset(batch, streets, manifest.join(keys, "dataset_key", "left_semi")).groupBy("dataset_key").agg(F.min_by("code", "severity").alias("error"))
            bad = written(bad, "bad")  # asked for twice, and small enough to be sent to tasks if it is
            runs = batch.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("records")).join(bad, "dataset_key", "left")
            runs = runs.withColumn("status", F.when(F.col("error").isNull(), "published").otherwise("failed"))
            good = batch.join(bad, "dataset_key", "left_anti")
            good.write.mode("overwrite").parquet(f"{table}/data/batch={batch_id}")
            runs.write.mode("overwrite").parquet(f"{table}/runs/batch={batch_id}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(RECORD).parquet(landing)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
