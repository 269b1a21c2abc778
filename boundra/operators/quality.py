"""Checks of requests, staged datasets, page and file sets, drift; partition assignment; paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from boundra.functions.ids import VOIVODESHIPS, decode_id, encode_id, once
from boundra.sources.storage import written

#: The extent of the register in EPSG:2180 and the parts of a shape file set.
EXTENT = (-50000.0, -100000.0, 1100000.0, 1100000.0)
CHECKS = ["DUPLICATE_ID", "INVALID_CRS", "INVALID_BBOX", "OUTSIDE_POLAND", "BROKEN_REFERENCE", "MANIFEST_MISMATCH"]
ROLES = {"shp": "shape", "shx": "index", "dbf": "attributes", "prj": "projection", "cpg": "encoding"}
REQUIRED = ["attributes", "index", "projection", "shape"]


def validate_requests(df: DataFrame, max_limit: int = 100, max_radius: float = 10000.0) -> DataFrame:
    """Status of each request by its ``limit``, ``radius`` and ``date`` (null asks for nothing)."""
    date = F.col("date")
    status = (
        F.when(F.col("limit").isNull() | (F.col("limit") < 1) | (F.col("limit") > max_limit), "INVALID_INPUT")
        .when(F.col("radius").isNotNull() & (F.isnan("radius") | (F.col("radius") <= 0)), "INVALID_INPUT")
        .when(F.col("radius") > max_radius, "RADIUS_LIMIT_EXCEEDED")
        .when(date.isNotNull() & (~date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date(date, "yyyy-MM-dd").isNull()), "INVALID_INPUT")
        .otherwise("OK")
    )
    return df.withColumn("status", status)


def validate_operations(df: DataFrame) -> DataFrame:
    """code and message of each request by the rules of its ``operation``, the first rule that it breaks; code OK if none.

    Columns, all of which may be null: limit, max_candidates, max_vertices, snapshot_id, tolerance, radius, x, y, date, query,
    code, category, structured (boolean), layers and shards (arrays).
    """
    c, op = F.col, F.col("operation")
    outside = lambda name, low, high: c(name).isNotNull() & ((c(name) < low) | (c(name) > high))
    finite = lambda name: c(name).isNotNull() & ~F.isnan(c(name)) & (F.abs(c(name)) < float("inf"))
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    none = lambda name: F.coalesce(F.size(name), F.lit(0)) <= 0
    day = c("date").isNotNull() & (~c("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date("date", "yyyy-MM-dd").isNull())
    bad = "INVALID_INPUT"
    rules = [
        (("relate_areas",), none("layers") & c("category").isNull(), "UNBOUNDED_SCAN_REFUSED", "layers or a category are asked for"),
        (("locate_point", "reverse_address"), ~finite("x") | ~finite("y"), bad, "coordinates must be finite"),
        (("reverse_address",), c("radius").isNotNull() & (F.isnan("radius") | (c("radius") <= 0)), bad, "radius must be above 0"),
        (("search_addresses",), ~blank == F.coalesce("structured", F.lit(False)), bad, "either a query or fields"),
        (("search_areas",), c("query").isNotNull() & blank, bad, "query must not be blank"),
        (("search_areas",), c("query").isNull() & c("code").isNull() & none("layers") & c("category").isNull(), bad, "a query, code, layer or category is asked for"),
        (("locate_point", "reverse_address", "search_addresses", "search_areas", "relate_areas"), outside("limit", 1, 100), bad, "limit must be 1 to 100"),
        (("locate_point", "relate_areas"), outside("max_candidates", 1, 10_000), bad, "max_candidates must be 1 to 10000"),
        (("reverse_address",), outside("max_candidates", 1, 5000), bad, "max_candidates must be 1 to 5000"),
        (("get_area_geometry",), outside("max_vertices", 4, 100_000), bad, "max_vertices must be 4 to 100000"),
        (("get_area_geometry",), c("tolerance").isNotNull() & (F.isnan("tolerance") | outside("tolerance", 0, 10_000)), bad, "tolerance must be 0 to 10000"),
        (("locate_point", "search_areas", "relate_areas"), c("snapshot_id") < 1, bad, "snapshot_id must be positive"),
        (("locate_point", "search_areas", "relate_areas"), day, bad, "date must be a day of the calendar"),
        (("locate_point",), c("layers").isNotNull() & none("layers"), bad, "layers must not be empty"),
        (("reverse_address", "search_addresses"), c("shards").isNotNull() & none("shards"), bad, "shards must not be empty"),
        (("reverse_address",), c("radius") > 10_000, "RADIUS_LIMIT_EXCEEDED", "radius must be 10000 at most"),
    ]
    known = sorted({o for ops, *_ in rules for o in ops})
    found = F.when(~F.coalesce(op.isin(known), F.lit(False)), F.struct(F.lit(bad).alias("code"), F.lit("unknown operation").alias("message")))
    for ops, broken, code, message in rules:
        found = found.when(op.isin(list(ops)) & F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    verdict = found.otherwise(F.struct(F.lit("OK").alias("code"), F.lit(None).cast("string").alias("message")))
    return df.withColumn("_v", verdict).select("*", F.col("_v.code").alias("verdict"), F.col("_v.message").alias("message")).drop("_v")


def validate_dataset(records: DataFrame, streets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations (code, dataset_key, object_id, severity) of all kinds, the first check first.

    ``records``: dataset_key, record_type, object_id, crs, street_id, min_x ... max_y. References are
    checked only where streets were imported at all. ``manifest``: dataset_key, expected.
    """
    box = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    finite = box[0].isNotNull()
    for c in box:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    proper = finite & (box[0] <= box[2]) & (box[1] <= box[3])
    inside = (box[0] >= EXTENT[0]) & (box[1] >= EXTENT[1]) & (box[2] <= EXTENT[2]) & (box[3] <= EXTENT[3])
    # what a record alone says moves no row; of repeated ones and of references only keys move, and records meet the few that are missing
    found = F.array(F.when(~F.col("crs").eqNullSafe("EPSG:2180"), CHECKS[1]), F.when(~proper, CHECKS[2]), F.when(proper & ~inside, CHECKS[3]))
    rows = records.select("dataset_key", "object_id", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("code"))
    twice = records.groupBy("dataset_key", "record_type", "object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.unionByName(twice.select("dataset_key", "object_id", F.explode(F.array_repeat(F.lit(CHECKS[0]), F.col("n").cast("int"))).alias("code")))
    missing = street_references(records.select("street_id").distinct(), streets)
    rows = rows.unionByName(records.join(missing, "street_id", "left_semi").select("dataset_key", "object_id", F.lit(CHECKS[4]).alias("code")))
    counts = records.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("n"))
    short = manifest.join(counts, "dataset_key", "left").filter(F.coalesce("n", F.lit(0)) != F.col("expected")).select("dataset_key", F.lit(None).cast("string").alias("object_id"), F.lit(CHECKS[5]).alias("code"))
    rank = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("code")).cast("int")
    return rows.unionByName(short).withColumn("severity", rank)


def street_references(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """Addresses whose street isn't among the imported ones, if any are."""
    some = streets.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    gone = addresses.filter("street_id IS NOT NULL").join(streets.select(F.col("object_id").alias("street_id")), "street_id", "left_anti")
    return gone.crossJoin(F.broadcast(some)).filter("_some").drop("_some")


def assign_partition(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their voivodeship_code, and those that have none.

    By the municipality code; else by the partitions of addresses on the same street, so a street may
    come out several times.
    """
    own = F.substring("municipality_code", 1, 2)
    marked = records.withColumn("_own", F.when(own.isin(VOIVODESHIPS), own))
    direct = marked.filter("_own IS NOT NULL").withColumnRenamed("_own", "voivodeship_code")
    hints = direct.filter("street_id IS NOT NULL").select(F.col("street_id").alias("_street"), F.col("voivodeship_code").alias("_hint")).distinct()
    rest = marked.filter("_own IS NULL").drop("_own").withColumn("_key", F.coalesce("street_id", "object_id"))
    hinted = rest.join(hints, F.col("_key") == F.col("_street"), "left").drop("_key", "_street")
    good = hinted.filter("_hint IS NOT NULL").withColumnRenamed("_hint", "voivodeship_code")
    return direct.unionByName(good), hinted.filter("_hint IS NULL").drop("_hint")


def installed_shards(coverage: DataFrame, present: DataFrame) -> DataFrame:
    """Voivodeships that count as installed.

    ``coverage``: scope_type, scope_code, completeness; ``present``: voivodeship_code of partitions with
    rows. Complete coverage decides; partial coverage alone hides a shard; without any, rows do.
    """
    c = coverage.filter("scope_type <> 'country'").groupBy(F.substring("scope_code", 1, 2).alias("voivodeship_code")).agg(F.bool_or((F.col("scope_type") == "voivodeship") & (F.col("completeness") == "complete")).alias("done"))
    p = present.select("voivodeship_code").distinct().withColumn("rows", F.lit(True))
    return c.join(p, "voivodeship_code", "full_outer").filter(F.coalesce("done", "rows")).select("voivodeship_code")


def page_after(df: DataFrame, keys: list[str], after: list[Column], limit: int, version: str, current: str) -> DataFrame:
    """The next ``limit`` rows after a key; a cursor of another version gives one row with status CURSOR_STALE."""
    if version != current:
        return df.sparkSession.range(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.lit("CURSOR_STALE").alias("status"))
    here = F.struct(*[F.col(k) for k in keys])
    there = F.struct(*[a.cast(df.schema[k].dataType).alias(k) for k, a in zip(keys, after)])
    return df.filter(here > there).orderBy(*keys).limit(limit).withColumn("status", F.lit("OK"))


CURSOR = "snapshot_version string, offset bigint, sort_key array<string>"


def encode_cursor(version: Column, offset: Column, sort_key: list[Column]) -> Column:
    """An opaque cursor: the snapshot's version, how many rows went before, and the sort key of the last of them."""
    return encode_id(snapshot_version=version, offset=offset.cast("bigint"), sort_key=F.array(*[k.cast("string") for k in sort_key]))


def pages_after(df: DataFrame, keys: list[str], cursors: DataFrame, limit: int, version: str, verify: bool = False) -> DataFrame:
    """The next ``limit`` rows for each request (request_id, cursor), with place, status and next_cursor.

    A null cursor begins; one of another version gives one row with CURSOR_STALE, one that is none INVALID_CURSOR; with ``verify``,
    CURSOR_STALE also if not as many rows as it says go before it. ``next_cursor`` stands in the last row of a full page.

    Rows and cursors are put in one order, by ranges. Rows are counted in their range, and sums of the ranges before give each its place;
    a cursor's place says which rows are its page, and both meet by the page's number. A row moves twice, however many cursors there are.
    """
    spark = df.sparkSession
    c = once(once(cursors.select("request_id", "cursor"), "cursor", F.col("cursor")), "_c", decode_id(F.col("cursor"), CURSOR))
    good = F.col("cursor").isNull() | (F.col("_c.snapshot_version").isNotNull() & F.col("_c.offset").isNotNull() & (F.size("_c.sort_key") == len(keys)))
    c = c.withColumn("status", F.when(~F.coalesce(good, F.lit(False)), "INVALID_CURSOR").when(F.col("_c.snapshot_version") != version, "CURSOR_STALE").otherwise("OK"))
    c = written(c, "cursors")
    begin = c.filter("status = 'OK' AND cursor IS NULL").select("request_id", F.lit(0).cast("bigint").alias("_offset"), F.lit(0).cast("bigint").alias("_before"))
    after = c.filter("status = 'OK' AND cursor IS NOT NULL").select(*[F.get("_c.sort_key", k).try_cast(df.schema[n].dataType).alias(n) for k, n in enumerate(keys)], F.struct("request_id", F.col("_c.offset").alias("offset")).alias("_asked"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = df.withColumn("_row", F.struct(*df.columns)).select(*keys, "_row").unionByName(after, allowMissingColumns=True).withColumn("_last", F.col("_asked").isNotNull())
    ordered = both.repartitionByRange(n, *keys, "_last").sortWithinPartitions(*keys, "_last")
    ordered = written(ordered.select("_row", "_asked", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    counts = {r["_part"]: r.n for r in ordered.groupBy("_part").agg(F.count("_row").alias("n")).collect()}  # one row a range
    sums, total = [], 0
    for part in sorted(counts):
        sums.append((part, total))
        total += counts[part]
    placed = ordered.withColumn("_n", F.count("_row").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(F.broadcast(spark.createDataFrame(sums, "_part int, _sum bigint")), "_part").withColumn("_place", F.col("_n") + F.col("_sum"))
    asked = begin.unionByName(placed.filter("_asked IS NOT NULL").select("_asked.request_id", F.col("_asked.offset").alias("_offset"), F.col("_place").alias("_before")))
    wrong = c.filter("status <> 'OK'").select("request_id", "status")
    if verify:
        wrong = wrong.unionByName(asked.filter("_offset <> _before").select("request_id", F.lit("CURSOR_STALE").alias("status")))
        asked = asked.filter("_offset = _before")
    page = lambda place: F.floor((place - 1) / limit).cast("bigint")
    spread = asked.withColumn("_page", F.explode(F.array_distinct(F.array(page(F.col("_before") + 1), page(F.col("_before") + limit)))))
    rows = placed.filter("_row IS NOT NULL").select("_row", "_place", page(F.col("_place")).alias("_page"))
    met = spread.join(rows, "_page").filter((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + limit)).withColumn("rank", (F.col("_place") - F.col("_before")).cast("int"))
    following = F.when(F.col("rank") == limit, encode_cursor(F.lit(version), F.col("_offset") + limit, [F.col(f"_row.{k}") for k in keys]))
    out = met.select("request_id", *[F.col(f"_row.{x}").alias(x) for x in df.columns], (F.col("_offset") + F.col("rank")).alias("place"), F.lit("OK").alias("status"), following.alias("next_cursor"))
    return out.unionByName(wrong, allowMissingColumns=True)


def read_page_files(spark: SparkSession, path: str, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Page files (dataset=.../*): dataset, file, bytes, value of those within the ceiling; and the files that pass it."""
    files = spark.read.format("binaryFile").load(path)  # listed once; what passes the ceiling isn't opened
    named = [F.col("dataset"), F.regexp_extract("path", r"[^/]*$", 0).alias("file"), F.col("length").alias("bytes")]
    kept = files.filter(F.col("length") <= most_bytes).select(*named, F.col("content").cast("string").alias("value"))
    return kept, files.filter(F.col("length") > most_bytes).select(*named, F.lit("TOO_LARGE").alias("status"))


def check_page_set(pages: DataFrame) -> DataFrame:
    """Status of each dataset's pages (dataset, matched, rows, bytes): stated totals must agree with each other and the rows."""
    s = pages.groupBy("dataset").agg(F.countDistinct(F.when(F.col("matched") != "unknown", F.col("matched"))).alias("totals"), F.max(F.when(F.col("matched") != "unknown", F.col("matched").try_cast("bigint"))).alias("stated"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return s.withColumn("status", F.when(F.col("totals") > 1, "TOTALS_DIFFER").when((F.col("totals") == 1) & (F.col("stated") != F.col("rows")), "ROWS_MISSING").otherwise("OK")).select("dataset", "rows", "bytes", "status")


def _packed(text: str) -> Column:
    """A text as bytes, those of lower-case hex digits packed; different texts stay different."""
    return F.when(F.col(text).rlike("^([0-9a-f]{2})*$"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def check_file_sets(listing: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Status of each base name of ``path``: the roles it has by extension and those it lacks.

    With ``allowed`` (a column fingerprint), ``listing`` has a ``fingerprint`` for each file too, and a whole set
    with a file whose fingerprint isn't allowed is NOT_ALLOWED.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    # roles are bits, and fingerprints in lower-case hex half as many bytes: that is what moves
    known = sorted(ROLES.values())
    bit = F.element_at(F.create_map(*[F.lit(x) for e, r in ROLES.items() for x in (e, 1 << known.index(r))]), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))
    s = listing.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("base"), F.coalesce(bit, F.lit(0)).cast("int").alias("bit"), *([_packed("fingerprint").alias("_print")] if allowed is not None else []))
    foreign = F.lit(False)
    if allowed is not None:
        s = s.join(allowed.select(_packed("fingerprint").alias("_print")).distinct().withColumn("_allowed", F.lit(True)), "_print", "left")
        foreign = F.col("_allowed").isNull()
    g = s.groupBy("base").agg(F.bit_or("bit").alias("_bits"), F.min("bit").alias("_least"), F.bool_or(foreign).alias("foreign"))
    has = F.filter(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(1 << k).alias("b")) for k, r in enumerate(known)]), lambda x: F.col("_bits").bitwiseAND(x["b"]) != 0)
    g = g.select("base", F.transform(has, lambda x: x["r"]).alias("roles"), (F.col("_least") == 0).cast("int").alias("unsupported"), "foreign")
    lacks = F.array_join(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), F.col("roles")), ",")
    status = F.when(F.col("unsupported") > 0, "UNSUPPORTED").when(lacks != "", "INCOMPLETE").when(F.col("foreign"), "NOT_ALLOWED").otherwise("OK")
    return g.select("base", F.array_join("roles", ",").alias("roles"), lacks.alias("missing"), status.alias("status"))


def catalog_drift(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """added, removed and changed entries by ``name``, one row for each changed column."""
    e = expected.select("name", *[F.col(c).alias(f"e_{c}") for c in columns]).withColumn("_e", F.lit(True))
    a = actual.select("name", *[F.col(c).alias(f"a_{c}") for c in columns]).withColumn("_a", F.lit(True))
    j = e.join(a, "name", "full_outer")
    none = F.lit(None).cast("string")
    issue = lambda kind, column, was, now: F.struct(F.lit(kind).alias("kind"), (F.lit(column) if column else none).alias("column"), was.alias("expected"), now.alias("actual"))
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    found = [F.when(F.col("_e").isNull(), issue("added", None, none, none)), F.when(F.col("_a").isNull(), issue("removed", None, none, none))]
    found += [F.when(both & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), issue("changed", c, F.col(f"e_{c}").cast("string"), F.col(f"a_{c}").cast("string"))) for c in columns]
    return j.select("name", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("name", "i.kind", "i.column", "i.expected", "i.actual")


def schema_fingerprint(fields: DataFrame) -> DataFrame:
    """SHA-256 of the fields (name, type, required) sorted by name."""
    return fields.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "type", "required")))), 256).alias("fingerprint"))


def table_fields(df: DataFrame) -> DataFrame:
    """Fields (position, name, type, required) of a table's columns that have values: ``number`` if every value is one, else ``text``.

    One aggregate a column, so that a table is read once and gives one row a task; only texts are looked at value by value.
    """
    seen = []
    for k, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = F.lit(True) if isinstance(f.dataType, NumericType) else F.bool_and(F.when(c.isNotNull(), c.try_cast("double").isNotNull())) if isinstance(f.dataType, StringType) else F.lit(False)
        seen.append(F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("name"), F.when(number, "number").otherwise("text").alias("type"), F.lit(True).alias("required"), (F.count(c) > 0).alias("_any")))
    fields = df.agg(F.array(*seen).alias("_f")).select(F.explode("_f").alias("_f")).select("_f.*")
    return fields.filter("_any").drop("_any")


def schema_drift(expected: DataFrame, actual: DataFrame, critical: list[str]) -> DataFrame:
    """compatible, warning or breaking, with the counts behind it. Fields: position, name, type, required."""
    e = expected.select("name", F.col("type").alias("e_type"), F.col("position").alias("e_pos"))
    a = actual.select("name", F.col("type").alias("a_type"), F.col("position").alias("a_pos"))
    j = e.join(a, "name", "full_outer")
    both = F.col("e_pos").isNotNull() & F.col("a_pos").isNotNull()
    s = j.agg(
        F.count_if(F.col("e_pos").isNull()).alias("added"), F.count_if(F.col("a_pos").isNull()).alias("missing"), F.count_if(F.col("a_pos").isNull() & F.col("name").isin(critical)).alias("missing_critical"),
        F.count_if(both & (F.col("e_type") != F.col("a_type"))).alias("type_changes"), F.count_if(both & (F.col("e_pos") != F.col("a_pos"))).alias("moved"),
    )
    verdict = F.when((F.col("missing_critical") > 0) | (F.col("type_changes") > 0), "breaking").when((F.col("added") > 0) | (F.col("missing") > 0) | (F.col("moved") > 0), "warning").otherwise("compatible")
    return s.withColumn("verdict", verdict)
