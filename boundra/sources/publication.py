"""Snapshots published as immutable folders, with their coverage and run tables, by moving one pointer.

    root/data/<id>/snapshot_id=N    rows of a publication
    root/tables/<id>/<name>         tables as they were after it: coverage, snapshots, runs
    root/_pending/<id>.json         publications that have begun and aren't over
    root/_manifest                  which folders hold

Rows and tables are written and checked before the manifest's next version names them, so a reader sees all of a publication or
nothing of it. What the version before names is kept until the next publication; one that was stopped is found by its pending file, and
``recover`` ends it if its version was written, else undoes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.operators.snapshots import upsert
from boundra.sources.manifest import Conflict, Manifest
from boundra.sources.storage import written

#: Keys of the tables that go with a publication, as operators use them.
KEYS = {"coverage": ["layer_id", "dataset_key", "archive_year", "scope_type", "scope_code"], "snapshots": ["dataset_key", "scope", "state_date"], "runs": ["run_id", "dataset_key"]}
#: How often a publication is put on top of another's that came between.
TRIES = 5


def _nothing(step: str) -> None:
    pass


def _says(manifest: Manifest) -> tuple[int, dict]:
    version, says = manifest.read()
    return version, says or {"snapshots": {}, "tables": {}, "batches": {}, "before": []}


def _folders(says: dict) -> set[str]:
    """Publication folders that a version names: data/<id>, tables/<id>."""
    return {"/".join(p.split("/")[:2]) for p in [*says["snapshots"].values(), *says["tables"].values()]}


def publish_snapshots(
    df: DataFrame, root: str, tables: dict[str, DataFrame] | Callable[[DataFrame], dict[str, DataFrame]] | None = None, check: Callable[[DataFrame], DataFrame] | None = None,
    batch: tuple[str, int] | None = None, after: Callable[[str], None] = _nothing,
) -> DataFrame:
    """Publish the rows of ``df`` by their ``snapshot_id``: snapshot_id, status, records, error.

    ``check`` gives (snapshot_id, code) of what is wrong with the rows as they are read back; a snapshot it names isn't
    published, the others are. ``tables`` has new rows for coverage, snapshots or runs, or makes them from the report; they replace those with the
    same KEYS; coverage and snapshots of a failed snapshot are left out. A ``batch`` (its stream's name, its number) that was published before is skipped, with
    the report empty. ``after`` is told each step that is done.
    """
    spark, manifest = df.sparkSession, Manifest(df.sparkSession, root)
    root, own = manifest.root, uuid.uuid4().hex
    kind = df.schema["snapshot_id"].dataType
    if batch and _says(manifest)[1]["batches"].get(batch[0], -1) >= batch[1]:
        return spark.createDataFrame([], f"snapshot_id {kind.simpleString()}, status string, records bigint, error string")
    pending = f"{root}/_pending/{own}.json"
    manifest.put(pending, json.dumps({"folders": [f"data/{own}", f"tables/{own}"]}))
    after("begun")
    df.write.partitionBy("snapshot_id").parquet(f"{root}/data/{own}")
    after("staged")
    staged = _read_folder(spark, root, f"data/{own}", df.schema)
    counts = staged.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("records"))
    wrong = check(staged) if check else staged.select("snapshot_id", F.lit("").alias("code")).filter("false")
    report = counts.join(wrong.groupBy("snapshot_id").agg(F.min("code").alias("error")), "snapshot_id", "left")
    report = written(report.select("snapshot_id", F.when(F.col("error").isNull(), "published").otherwise("failed").alias("status"), "records", "error"), "report")
    rows = report.select("snapshot_id", "status").collect()  # one for each snapshot of this publication
    good = [r.snapshot_id for r in rows if r.status == "published"]
    after("checked")
    given = (tables(report) if callable(tables) else tables) or {}
    for attempt in range(TRIES):
        version, says = _says(manifest)
        new = {"snapshots": {**says["snapshots"], **{str(n): f"data/{own}/snapshot_id={n}" for n in good}}, "tables": dict(says["tables"]), "batches": dict(says["batches"]), "before": sorted(_folders(says))}
        for name, updates in given.items():
            if "snapshot_id" in updates.columns and name != "runs":
                updates = updates.join(report.filter("status = 'failed'").select("snapshot_id"), "snapshot_id", "left_anti").select(*updates.columns)
            old = says["tables"].get(name)
            now = upsert(spark.read.parquet(f"{root}/{old}"), updates, KEYS[name]) if old else updates
            place = f"tables/{own}/{name}-{attempt}"
            now.write.parquet(f"{root}/{place}")
            new["tables"][name] = place
        if batch:
            new["batches"][batch[0]] = batch[1]
        after("tables")
        try:
            manifest.commit(version, new)
            break
        except Conflict:
            if attempt == TRIES - 1:
                manifest.delete(f"{root}/data/{own}")
                manifest.delete(f"{root}/tables/{own}")
                manifest.delete(pending)
                raise
    after("committed")
    manifest.delete(pending)
    _clean(manifest)
    after("cleaned")
    return report


def _read_folder(spark: SparkSession, root: str, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{folder}")


def _pending(manifest: Manifest) -> dict[str, list[str]]:
    """Folders of publications that have begun and aren't over, by their pending file."""
    at = manifest.at(f"{manifest.root}/_pending")
    if not manifest.fs.exists(at):
        return {}
    paths = [str(s.getPath().toString()) for s in manifest.fs.listStatus(at) if s.getPath().getName().endswith(".json")]
    return {p: json.loads(manifest.text(p))["folders"] for p in paths}


def _clean(manifest: Manifest) -> None:
    """Delete folders that neither the version in force, nor the one before, nor a publication on its way names."""
    _, says = _says(manifest)
    kept = _folders(says) | set(says["before"]) | {f for folders in _pending(manifest).values() for f in folders}
    for top in ("data", "tables"):
        at = manifest.at(f"{manifest.root}/{top}")
        for s in manifest.fs.listStatus(at) if manifest.fs.exists(at) else []:
            if f"{top}/{s.getPath().getName()}" not in kept:
                manifest.fs.delete(s.getPath(), True)


def recover(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """End or undo publications that were stopped: their folders' id and ``ended`` or ``undone``. None may be on its way."""
    manifest, out = Manifest(spark, root), []
    named = _folders(_says(manifest)[1])
    for path, folders in sorted(_pending(manifest).items()):
        ended = any(f in named for f in folders)
        for f in [] if ended else folders:
            manifest.delete(f"{manifest.root}/{f}")
        manifest.delete(path)
        out.append((folders[0].split("/")[1], "ended" if ended else "undone"))
    _clean(manifest)
    return out


def read_snapshots(spark: SparkSession, root: str, ids: list[int] | None = None) -> DataFrame | None:
    """Rows of the published snapshots, or of those asked for; None if there are none."""
    manifest = Manifest(spark, root)
    _, says = _says(manifest)
    by_folder: dict[str, list[str]] = {}
    for n, path in says["snapshots"].items():
        if ids is None or int(n) in ids:
            by_folder.setdefault(path.rsplit("/", 1)[0], []).append(n)
    out = None
    for folder, numbers in sorted(by_folder.items()):
        one = spark.read.parquet(f"{manifest.root}/{folder}").filter(F.col("snapshot_id").isin([int(n) for n in numbers])).withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """coverage, snapshots or runs as of the version in force."""
    manifest = Manifest(spark, root)
    path = _says(manifest)[1]["tables"].get(name)
    return None if path is None else spark.read.parquet(f"{manifest.root}/{path}")
