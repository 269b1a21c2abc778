"""Publications that stop after any step, and datasets that land in several packages."""

import time

import pytest
from pyspark.sql import functions as F

from boundra.sources.manifest import Conflict, Manifest
from boundra.sources.publication import publish_snapshots, read_snapshots, read_table, recover
from boundra.sources.storage import shared_path
from boundra.streaming.packages import PACKAGE, ingest_packages

COVERAGE = "layer_id string, dataset_key string, archive_year int, scope_type string, scope_code string, snapshot_id bigint, completeness string"


class Stopped(Exception):
    pass


def rows(spark, snapshot, values):
    return spark.createDataFrame([(v, snapshot) for v in values], "v int, snapshot_id bigint")


def coverage(spark, snapshot):
    return {"coverage": spark.createDataFrame([("A03", "current:A03", 0, "country", "PL", snapshot, "complete")], COVERAGE)}


def seen(spark, root):
    df, c = read_snapshots(spark, root), read_table(spark, root, "coverage")
    return (sorted((r.snapshot_id, r.v) for r in df.collect()) if df is not None else [], [r.snapshot_id for r in c.collect()] if c is not None else [])


@pytest.mark.parametrize("step, outcome", [("begun", "undone"), ("staged", "undone"), ("checked", "undone"), ("tables", "undone"), ("committed", "ended")])
def test_a_publication_that_stops(spark, step, outcome):
    """Whatever the step, readers have the whole old state or the whole new one, before and after recovery, and the next publication works."""
    root = shared_path(spark, "publication")
    publish_snapshots(rows(spark, 1, [1, 2]), root, coverage(spark, 1))
    old, new = ([(1, 1), (1, 2)], [1]), ([(1, 1), (1, 2), (2, 7)], [2])

    def stop(done):
        if done == step:
            raise Stopped(done)

    with pytest.raises(Stopped):
        publish_snapshots(rows(spark, 2, [7]), root, coverage(spark, 2), after=stop)
    state = new if outcome == "ended" else old
    assert seen(spark, root) == state
    assert [o for _, o in recover(spark, root)] == [outcome] and recover(spark, root) == []
    assert seen(spark, root) == state
    publish_snapshots(rows(spark, 2, [8]), root, coverage(spark, 2))
    assert seen(spark, root) == ([(1, 1), (1, 2), (2, 8)], [2])


def test_failed_snapshots_and_old_folders(spark):
    root = shared_path(spark, "publication")
    wrong = lambda df: df.filter("v < 0").select("snapshot_id", F.lit("NEGATIVE").alias("code"))
    both = rows(spark, 1, [1]).unionByName(rows(spark, 2, [-1, 5]))
    report = publish_snapshots(both, root, {"coverage": coverage(spark, 1)["coverage"].unionByName(coverage(spark, 2)["coverage"].withColumn("layer_id", F.lit("A02")))}, wrong)
    assert sorted(map(tuple, report.collect())) == [(1, "published", 1, None), (2, "failed", 2, "NEGATIVE")]
    assert seen(spark, root) == ([(1, 1)], [1])
    before = read_snapshots(spark, root)  # a reader that has begun
    publish_snapshots(rows(spark, 1, [3]), root)
    assert [r.v for r in before.collect()] == [1]  # what the version before names is still there
    publish_snapshots(rows(spark, 1, [4]), root)
    manifest = Manifest(spark, root)
    assert manifest.fs.listStatus(manifest.at(f"{root}/data")).__len__() == 2
    assert seen(spark, root) == ([(1, 4)], [1])
    # a batch that is run again, and two publishers at once
    publish_snapshots(rows(spark, 5, [5]), root, batch=("s", 3))
    assert publish_snapshots(rows(spark, 5, [6]), root, batch=("s", 3)).count() == 0 and (5, 5) in seen(spark, root)[0]
    between = []

    def other(step):
        if step == "tables" and not between:
            between.append(publish_snapshots(rows(spark, 6, [6]), root, coverage(spark, 6)))

    publish_snapshots(rows(spark, 7, [7]), root, {"coverage": coverage(spark, 7)["coverage"].withColumn("layer_id", F.lit("A09"))}, after=other)
    assert {(6, 6), (7, 7)} <= set(seen(spark, root)[0]) and sorted(seen(spark, root)[1]) == [6, 7]
    with pytest.raises(Conflict):
        manifest.commit(1, {})


def land(spark, landing, packages):
    """Packages (dataset, package, ids) as a file each."""
    for dataset, package, ids in packages:
        made = [(dataset, "address", str(i), "EPSG:2180" if dataset != "bad" else "EPSG:4326", None, 0.0, 0.0, 1.0, 1.0, package) for i in ids]
        spark.createDataFrame(made, PACKAGE).coalesce(1).write.mode("append").parquet(landing)


def test_datasets_in_several_packages(spark):
    """One lands in three runs, one twice, one is wrong, one never ends; unknown ones are left alone."""
    base = shared_path(spark, "stream")
    landing, root, state = f"{base}/in", f"{base}/root", f"{base}/state"
    streets = spark.createDataFrame([], "object_id string")
    manifest = spark.createDataFrame([("three", 6, 1, "A01"), ("twice", 2, 2, "A02"), ("bad", 1, 3, "A03"), ("never", 9, 4, "A04")], "dataset_key string, expected long, snapshot_id long, layer_id string")
    run = lambda: ingest_packages(spark, landing, root, state, streets, manifest, timeout_ms=1000)

    def published():
        df = read_snapshots(spark, root)
        return sorted((r.dataset_key, r.snapshot_id, r.object_id) for r in df.collect()) if df is not None else []

    twice = [("twice", 2, "10"), ("twice", 2, "11")]
    land(spark, landing, [("three", "p1", [1, 2]), ("twice", "q1", [10]), ("twice", "q1", [10]), ("never", "n1", [5]), ("foreign", "f", [1])])
    run()
    assert published() == []
    land(spark, landing, [("three", "p2", [3]), ("three", "p1", [1, 2]), ("twice", "q2", [11]), ("bad", "b", [1])])
    run()
    assert published() == twice
    time.sleep(1.5)
    land(spark, landing, [("three", "p3", [4, 5, 6]), ("twice", "q3", [12])])
    run()
    expired = {r.dataset_key for r in read_table(spark, root, "runs").filter("error = 'EXPIRED'").collect()}
    assert "never" in expired
    if "three" not in expired:  # its state may have timed out before the last package
        assert published() == sorted([("three", 1, str(i)) for i in range(1, 7)] + twice)
    runs = {(r.dataset_key, r.status, r.error, r.records) for r in read_table(spark, root, "runs").collect()}
    assert {("twice", "published", None, 2), ("bad", "failed", "INVALID_CRS", 1), ("never", "failed", "EXPIRED", 1)} <= runs
    assert {r.dataset_key: r.snapshot_id for r in read_table(spark, root, "coverage").filter("dataset_key <> 'three'").collect()} == {"twice": 2}
