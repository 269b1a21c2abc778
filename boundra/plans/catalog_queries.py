"""Driver queries of coverage, snapshots, planning, quality and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundra.operators import catalog, coverage, planning, quality
from boundra.operators.snapshots import dedupe_snapshots, latest_per_key, upsert
from boundra.plans import fixtures as fx
from boundra.plans.registry import query, table
from boundra.sources.storage import written

_COV = "cov AS (SELECT CAST(user_id AS VARCHAR) AS layer_id, event_type AS scope, CASE WHEN event_id % 11 = 0 THEN 'partial' ELSE 'complete' END AS completeness, ts AS downloaded_at, event_id FROM events)"


def _coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("layer_id"), F.col("event_type").alias("scope"), F.when(F.col("event_id") % 11 == 0, "partial").otherwise("complete").alias("completeness"), F.col("ts").alias("downloaded_at"), "event_id")


def _requested(spark, sf_dir):
    c = _coverage(spark, sf_dir)
    # pairs of even rows only are taken as installed, so that some are missing
    return coverage.requested_pairs(c, c), c.filter("event_id % 3 = 0")


@query(
    "coverage_summary",
    f"""WITH {_COV}, have AS (SELECT layer_id, scope, bool_or(completeness = 'complete') AS done, max(CASE WHEN completeness = 'complete' THEN downloaded_at END) AS at_ FROM cov WHERE event_id % 3 = 0 GROUP BY ALL),
req AS (SELECT DISTINCT CAST(a.layer_id AS BIGINT) % 20 AS request_id, a.layer_id, b.scope FROM cov a, (SELECT DISTINCT scope FROM cov) b),
j AS (SELECT req.*, done, coalesce(done, false) AS ok, at_ FROM req LEFT JOIN have USING (layer_id, scope))
SELECT request_id, count(*) AS asked, count(*) FILTER (ok) AS installed, coalesce(string_agg(DISTINCT CASE WHEN NOT ok THEN scope END, ',' ORDER BY CASE WHEN NOT ok THEN scope END), '') AS missing_scopes, max(at_) AS synced_at,
  CASE WHEN count(done) = 0 THEN 'unknown' WHEN count(*) FILTER (ok) = count(*) THEN 'complete' ELSE 'partial' END AS state
FROM j GROUP BY request_id""",
)
def coverage_summary(spark, sf_dir):
    pairs, installed = _requested(spark, sf_dir)
    return coverage.coverage_summary(pairs.withColumn("request_id", F.col("layer_id").cast("bigint") % 20), installed)


@query(
    "missing_pairs",
    f"""WITH {_COV} SELECT layer_id, scope, layer_id || ':' || scope AS label FROM (SELECT DISTINCT layer_id FROM cov), (SELECT DISTINCT scope FROM cov)
WHERE (layer_id, scope) NOT IN (SELECT (layer_id, scope) FROM cov WHERE event_id % 3 = 0)""",
)
def missing_pairs(spark, sf_dir):
    pairs, installed = _requested(spark, sf_dir)
    half = installed.filter("event_id % 2 = 0")
    return coverage.missing_pairs(pairs, coverage.merge_pairs(half, installed.filter("event_id % 2 = 1")))


@query(
    "source_status",
    f"""WITH {_COV}, done AS (SELECT DISTINCT layer_id, scope FROM cov WHERE event_id % 3 = 0 AND completeness = 'complete'),
req AS (SELECT * FROM (SELECT DISTINCT layer_id FROM cov), (SELECT DISTINCT scope FROM cov))
SELECT count(DISTINCT layer_id) AS layers, count(*) AS pairs, (SELECT count(*) FROM req ANTI JOIN done USING (layer_id, scope)) AS missing, (SELECT count(*) FROM req ANTI JOIN done USING (layer_id, scope)) = 0 AS complete FROM done""",
)
def source_status(spark, sf_dir):
    pairs, installed = _requested(spark, sf_dir)
    return coverage.source_status(installed, pairs)


@query(
    "coverage_provenance",
    f"""WITH {_COV}, sn AS (SELECT event_id AS id, ts, props FROM events WHERE event_id % 2 = 0)
SELECT layer_id, scope, event_id AS snapshot_id, ts AS downloaded_at, props AS etag FROM cov JOIN sn ON id = event_id WHERE completeness = 'complete'""",
)
def coverage_provenance(spark, sf_dir):
    c = _coverage(spark, sf_dir).select("layer_id", "scope", "completeness", F.col("event_id").alias("snapshot_id"))
    s = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("downloaded_at"), F.col("props").alias("etag"))
    return coverage.coverage_with_provenance(c, s, complete_only=True).select("layer_id", "scope", "snapshot_id", "downloaded_at", "etag")


_LISTED = f"""WITH {fx.AREAS}, cv AS (SELECT 'L0' || CAST(user_id % 4 + 1 AS VARCHAR) AS layer_id, event_type AS scope, CASE WHEN event_id % 11 = 0 OR user_id % 4 = 3 THEN 'partial' ELSE 'complete' END AS completeness FROM events),
cnt AS (SELECT layer_id, count(*) AS records FROM a WHERE layer_id <> 'L02' OR k % 2 = 0 GROUP BY ALL),
held AS (SELECT layer_id, coalesce(string_agg(DISTINCT CASE WHEN completeness = 'complete' THEN scope END, ',' ORDER BY CASE WHEN completeness = 'complete' THEN scope END), '') AS scopes FROM cv GROUP BY ALL),
ly AS (SELECT unnest(['L01', 'L02', 'L03', 'L04', 'L05']) AS layer_id),
li AS (SELECT layer_id, coalesce(records, 0) AS records, coalesce(scopes, '') AS scopes, CASE WHEN scopes IS NULL THEN coalesce(records, 0) > 0 ELSE scopes <> '' END AS available FROM ly LEFT JOIN cnt USING (layer_id) LEFT JOIN held USING (layer_id))"""


def _listed(spark, sf_dir):
    a = fx.areas(spark, sf_dir).withColumn("snapshot_id", F.when(F.col("layer_id") == "L02", F.col("k") % 2).otherwise(F.lit(5)).cast("bigint"))
    current = spark.range(1).select(F.lit("L02").alias("layer_id"), F.lit(0).cast("bigint").alias("snapshot_id"))
    e = table(spark, sf_dir, "events")
    cov = e.select(F.concat(F.lit("L0"), (F.col("user_id") % 4 + 1).cast("string")).alias("layer_id"), F.col("event_type").alias("scope"), F.when((F.col("event_id") % 11 == 0) | (F.col("user_id") % 4 == 3), "partial").otherwise("complete").alias("completeness"))
    layers = spark.range(5).select(F.concat(F.lit("L0"), (F.col("id") + 1).cast("string")).alias("layer_id"))
    return coverage.list_layers(layers, coverage.layer_counts(a, current), cov)


@query("layer_catalog", f"{_LISTED} SELECT layer_id, records, scopes, available FROM li")
def layer_catalog(spark, sf_dir):
    return _listed(spark, sf_dir).select("layer_id", "records", "scopes", "available")


@query("coverage_report", f"{_LISTED} SELECT count(*) FILTER (available) AS installed, count(*) AS total FROM li")
def coverage_report(spark, sf_dir):
    return coverage.coverage_report(_listed(spark, sf_dir))


_SNAP = "sn AS (SELECT event_id AS id, 'current:' || CAST(user_id AS VARCHAR) AS dataset_key, event_type AS scope, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS state_date, ts AS downloaded_at, props AS etag FROM events)"


def _snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("current:"), F.col("user_id").cast("string")).alias("dataset_key"), F.col("event_type").alias("scope"), F.when(F.col("event_id") % 4 != 0, F.to_date("ts").cast("string")).alias("state_date"), F.col("ts").alias("downloaded_at"), F.col("props").alias("etag"))


@query("latest_snapshots", f"WITH {_SNAP} SELECT dataset_key, scope, id, etag FROM sn QUALIFY row_number() OVER (PARTITION BY dataset_key, scope ORDER BY downloaded_at DESC, id DESC) = 1")
def latest_snapshots(spark, sf_dir):
    return latest_per_key(_snapshots(spark, sf_dir), ["dataset_key", "scope"], [F.col("downloaded_at").desc(), F.col("id").desc()]).select("dataset_key", "scope", "id", "etag")


@query(
    "upsert_snapshots",
    f"""WITH {_SNAP}, d AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY dataset_key, scope, coalesce(state_date, '') ORDER BY id) = 1),
u AS (SELECT * FROM sn WHERE id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY dataset_key, scope, coalesce(state_date, '') ORDER BY id DESC) = 1)
SELECT dataset_key, scope, state_date, id FROM u UNION ALL SELECT dataset_key, scope, state_date, id FROM d WHERE (dataset_key, scope, coalesce(state_date, '')) NOT IN (SELECT (dataset_key, scope, coalesce(state_date, '')) FROM u)""",
)
def upsert_snapshots(spark, sf_dir):
    s, keys = _snapshots(spark, sf_dir), ["dataset_key", "scope", F.coalesce("state_date", F.lit(""))]
    held = latest_per_key(s, keys, [F.col("id")])
    new = latest_per_key(s.filter("id % 10 = 0"), keys, [F.col("id").desc()])
    return upsert(held, new, ["dataset_key", "scope", "state_date"]).select("dataset_key", "scope", "state_date", "id")


@query(
    "dedupe_snapshots",
    f"""WITH {_SNAP}, m AS (SELECT id, max(id) OVER (PARTITION BY dataset_key, scope, coalesce(state_date, '')) AS keep FROM sn)
SELECT keep AS snapshot_id, count(*) AS n FROM m GROUP BY keep""",
)
def dedupe(spark, sf_dir):
    s = _snapshots(spark, sf_dir)
    kept, cov = dedupe_snapshots(s, s.select(F.col("id").alias("snapshot_id"), "scope"))
    return cov.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).join(kept.select(F.col("id").alias("snapshot_id")), "snapshot_id")


_PROBES = """old AS (SELECT * FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
pr AS (SELECT n.user_id, n.event_type, n.event_id, o.event_id IS NOT NULL AS known, o.ts AS checked_at, CASE WHEN o.event_id IS NULL THEN 'available' WHEN n.event_id % 7 <> o.event_id % 7 AND n.event_id % 3 = 0 THEN 'schema_changed'
  WHEN n.event_id % 5 = 0 AND CAST(n.ts AS DATE) <> CAST(o.ts AS DATE) THEN 'changed' WHEN n.props <> o.props THEN 'changed' ELSE 'available' END AS probe_status FROM new n LEFT JOIN old o USING (user_id, event_type))"""


def _probes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("dataset_key", F.col("user_id").cast("string")).withColumnRenamed("event_type", "scope")
    last = lambda df: latest_per_key(df, ["dataset_key", "scope"], [F.col("ts").desc(), F.col("event_id").desc()])
    day = F.to_date("ts").cast("string")
    old = last(e.filter("event_id % 2 = 0")).select("dataset_key", "scope", (F.col("event_id") % 7).cast("string").alias("fingerprint"), day.alias("state_date"), F.col("props").alias("etag"), F.lit(None).cast("string").alias("modified"), F.col("ts").alias("checked_at"))
    n = F.col("event_id")
    new = last(e.filter("event_id % 2 = 1")).select("dataset_key", "scope", n, F.when(n % 3 == 0, (n % 7).cast("string")).alias("p_fingerprint"), F.when(n % 5 == 0, day).alias("p_state_date"), F.col("props").alias("p_etag"), F.lit(None).cast("string").alias("p_modified"))
    return old, new


@query("classify_probes", f"WITH {_PROBES} SELECT CAST(user_id AS VARCHAR) AS dataset_key, event_type AS scope, probe_status FROM pr")
def classify_probes(spark, sf_dir):
    return planning.classify_probes(*_probes(spark, sf_dir))


@query(
    "sync_decisions",
    f"""WITH {_PROBES}, b AS (SELECT *, user_id % 4 = 0 AS archive, epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 - epoch_us(checked_at) // 1000000 AS age FROM pr)
SELECT CAST(user_id AS VARCHAR) AS dataset_key, event_type AS scope, CASE WHEN NOT archive AND probe_status = 'schema_changed' THEN 'blocked' WHEN archive AND known THEN 'unchanged'
  WHEN NOT known OR (NOT archive AND probe_status = 'changed') OR NOT coalesce(age >= 0 AND age < 86400, false) THEN 'synchronise' ELSE 'unchanged' END AS decision FROM b""",
)
def sync_decisions(spark, sf_dir):
    old, new = _probes(spark, sf_dir)
    keys = ["dataset_key", "scope"]
    t = new.select(*keys).join(old.select(*keys, "checked_at"), keys, "left").join(planning.classify_probes(old, new), keys)
    t = t.withColumn("known", F.col("checked_at").isNotNull()).withColumn("archive", F.col("dataset_key").cast("bigint") % 4 == 0)
    return planning.sync_decisions(t, "stale", F.lit("2024-01-20 00:00:00").cast("timestamp")).select(*keys, "decision")


def _mode_sql(mode: str) -> str:
    blocked = "NOT archive AND probe_status = 'schema_changed'"
    cases = {"stale": "NOT known OR (NOT archive AND probe_status = 'changed') OR NOT coalesce(age >= 0 AND age < 86400, false)", "missing": "NOT known", "force": "true"}
    first = {"missing": "WHEN known THEN 'unchanged'"}.get(mode, "")
    return f"SELECT CAST(user_id AS VARCHAR) AS dataset_key, event_type AS scope, '{mode}' AS mode, CASE {first} {'' if mode == 'force' else f'WHEN {blocked} THEN {chr(39)}blocked{chr(39)}'} WHEN archive AND known THEN 'unchanged' WHEN {cases[mode]} THEN 'synchronise' ELSE 'unchanged' END AS decision FROM b"


@query(
    "sync_decisions_all_modes",
    f"WITH {_PROBES}, b AS (SELECT *, user_id % 4 = 0 AS archive, epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 - epoch_us(checked_at) // 1000000 AS age FROM pr) " + " UNION ALL ".join(_mode_sql(m) for m in ("stale", "missing", "force")),
)
def sync_decisions_all_modes(spark, sf_dir):
    old, new = _probes(spark, sf_dir)
    keys = ["dataset_key", "scope"]
    t = new.select(*keys).join(old.select(*keys, "checked_at"), keys, "left").join(planning.classify_probes(old, new), keys)
    t = t.withColumn("known", F.col("checked_at").isNotNull()).withColumn("archive", F.col("dataset_key").cast("bigint") % 4 == 0)
    out = None
    for mode in ("stale", "missing", "force"):
        one = planning.sync_decisions(t, mode, F.lit("2024-01-20 00:00:00").cast("timestamp")).select(*keys, F.lit(mode).alias("mode"), "decision")
        out = one if out is None else out.unionByName(one)
    return out


_PLANS = """r AS (SELECT o_orderkey AS plan_id, o_orderkey % 10 AS m FROM orders),
t AS (
  SELECT plan_id, unnest(CASE m WHEN 0 THEN ['A05', 'A06'] WHEN 4 THEN ['A00', 'A01', 'A02', 'A03', 'A04'] WHEN 9 THEN ['A01', 'W01'] END) AS layer_id, 'country:PL' AS scope, 134217728 AS d, 335544320 AS k, m FROM r WHERE m IN (0, 4, 9)
  UNION ALL SELECT plan_id, l, 'voivodeship:' || lpad(CAST(2 * v AS VARCHAR), 2, '0'), 230686720, 922746880, m FROM r, (SELECT unnest(['A07', 'A08']) AS l), (SELECT unnest(range(1, 17)) AS v) WHERE m = 1
  UNION ALL SELECT plan_id, l, s.s, s.d, 4 * s.d, m FROM r, (SELECT unnest(['A07', 'A08']) AS l), (SELECT 'voivodeship:14' AS s, 230686720 AS d UNION ALL SELECT 'county:1465', 46137344 UNION ALL SELECT 'municipality:1465011', 9227469) s WHERE m = 2
)"""
_TARGETS = f"""WITH {_PLANS} SELECT plan_id, layer_id, CASE WHEN m = 4 THEN 'archive:2024:' ELSE 'current:' END || layer_id AS dataset_key, scope, CAST(d AS BIGINT) AS download_bytes, CAST(k AS BIGINT) AS disk_bytes, 'OK' AS status FROM t
UNION ALL SELECT plan_id, NULL, NULL, NULL, NULL, NULL, CASE m WHEN 3 THEN 'INVALID_TERYT' WHEN 5 THEN 'MISSING_ARCHIVE_YEAR' WHEN 6 THEN 'ARCHIVE_NOT_AVAILABLE' WHEN 7 THEN 'INVALID_LAYER' ELSE 'INVALID_PROFILE' END FROM r WHERE m IN (3, 5, 6, 7, 8)"""


def _plans(spark, sf_dir):
    m = F.col("plan_id") % 10
    profile = F.when(m == 0, "cadastre-boundaries").when(m.isin(1, 2), "addresses").when(m == 3, "maritime").when(m.isin(4, 5, 6), "administrative-history").when(m == 8, "unheard-of")
    ids = F.when(m == 7, F.array(F.lit("A01"), F.lit("Z99"))).when(m == 9, F.array(F.lit("A01"), F.lit("W01"), F.lit("A01")))
    scopes = F.when(m == 2, F.array(F.lit("14"), F.lit("1465"), F.lit("1465011"), F.lit("14"))).when(m == 3, F.array(F.lit("14")))
    year = F.when(m == 4, 2024).when(m == 6, 2013)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id")).select("plan_id", profile.alias("profile"), ids.alias("layer_ids"), scopes.alias("scopes"), year.alias("archive_year"), F.lit("stale").alias("mode"))


@query("plan_targets", _TARGETS)
def plan_targets(spark, sf_dir):
    return planning.plan_targets(spark, _plans(spark, sf_dir))


@query("plan_costs", f"WITH x AS ({_TARGETS}) SELECT plan_id, CAST(sum(download_bytes) AS BIGINT) AS download_bytes, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes, sum(disk_bytes) + 268435456 <= 3000000000 AS fits FROM x WHERE status = 'OK' GROUP BY plan_id")
def plan_costs(spark, sf_dir):
    return planning.plan_costs(planning.plan_targets(spark, _plans(spark, sf_dir)).filter("status = 'OK'"), 3_000_000_000)


@query(
    "run_report",
    """SELECT user_id AS run_id, count(*) AS targets, count(*) FILTER (event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id""",
)
def run_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("published").alias("status"))
    return planning.run_report(e)


@query(
    "request_validation",
    """WITH q AS (SELECT o_orderkey AS request_id, o_orderkey % 130 - 10 AS lim, o_totalprice / 10 AS radius, CASE WHEN o_orderkey % 13 = 0 THEN '2026-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders)
SELECT request_id, CASE WHEN lim < 1 OR lim > 100 OR radius <= 0 THEN 'INVALID_INPUT' WHEN radius > 10000 THEN 'RADIUS_LIMIT_EXCEEDED' WHEN d = '2026-02-31' THEN 'INVALID_INPUT' ELSE 'OK' END AS status FROM q""",
)
def request_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("request_id"), (k % 130 - 10).alias("limit"), (F.col("o_totalprice") / 10).alias("radius"), F.when(k % 13 == 0, "2026-02-31").otherwise(F.to_date("o_orderdate").cast("string")).alias("date"))
    return quality.validate_requests(r).select("request_id", "status")


_RECORDS = """rec AS (SELECT CAST(l_orderkey % 7 AS VARCHAR) AS dataset_key, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS object_id, l_partkey,
  CASE WHEN l_suppkey % 19 = 0 THEN 'EPSG:4326' ELSE 'EPSG:2180' END AS crs, l_extendedprice * 12 AS x, l_extendedprice * 12 + CASE WHEN l_orderkey % 23 = 0 THEN -1 ELSE 1 END AS x2 FROM lineitem)"""


def _records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice") * 12
    return li.select(
        (F.col("l_orderkey") % 7).cast("string").alias("dataset_key"), F.lit("address").alias("record_type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("object_id"),
        F.when(F.col("l_suppkey") % 19 == 0, "EPSG:4326").otherwise("EPSG:2180").alias("crs"), F.col("l_partkey").cast("string").alias("street_id"),
        x.alias("min_x"), F.lit(0.0).alias("min_y"), (x + F.when(F.col("l_orderkey") % 23 == 0, -1).otherwise(1)).alias("max_x"), F.lit(1.0).alias("max_y"),
    )


@query(
    "validate_dataset",
    f"""WITH {_RECORDS}, twice AS (SELECT dataset_key, object_id FROM rec GROUP BY ALL HAVING count(*) > 1)
SELECT dataset_key, object_id, 'DUPLICATE_ID' AS code, 1 AS severity FROM rec SEMI JOIN twice USING (dataset_key, object_id)
UNION ALL SELECT dataset_key, object_id, 'INVALID_CRS', 2 FROM rec WHERE crs <> 'EPSG:2180'
UNION ALL SELECT dataset_key, object_id, 'INVALID_BBOX', 3 FROM rec WHERE x > x2
UNION ALL SELECT dataset_key, object_id, 'OUTSIDE_POLAND', 4 FROM rec WHERE x <= x2 AND x2 > 1100000
UNION ALL SELECT dataset_key, object_id, 'BROKEN_REFERENCE', 5 FROM rec WHERE l_partkey % 17 = 0
UNION ALL SELECT dataset_key, NULL, 'MANIFEST_MISMATCH', 6 FROM (SELECT CAST(o_orderkey % 7 AS VARCHAR) AS dataset_key, count(*) AS m FROM orders GROUP BY ALL) JOIN (SELECT dataset_key, count(*) AS n FROM rec GROUP BY ALL) USING (dataset_key) WHERE m <> n""",
)
def validate_dataset(spark, sf_dir):
    streets = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0").select(F.col("p_partkey").cast("string").alias("object_id"))
    manifest = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 7).cast("string").alias("dataset_key")).agg(F.count(F.lit(1)).alias("expected"))
    return quality.validate_dataset(_records(spark, sf_dir), streets, manifest)


@query("street_references", f"WITH {_RECORDS} SELECT dataset_key, object_id FROM rec WHERE l_partkey % 17 = 0")
def street_references(spark, sf_dir):
    streets = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0").select(F.col("p_partkey").cast("string").alias("object_id"))
    return quality.street_references(_records(spark, sf_dir), streets).select("dataset_key", "object_id")


_ASSIGN = """lo AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS street_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN lpad(CAST(2 * (c_nationkey % 18) AS VARCHAR), 2, '0') || '01011' ELSE lpad(CAST(2 * (c_nationkey % 16 + 1) AS VARCHAR), 2, '0') || '01011' END AS m
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
own AS (SELECT *, CASE WHEN CAST(substr(m, 1, 2) AS INT) BETWEEN 2 AND 32 THEN substr(m, 1, 2) END AS v FROM lo), h AS (SELECT DISTINCT street_id, v FROM own WHERE v IS NOT NULL),
res AS (SELECT l_orderkey, l_linenumber, v FROM own WHERE v IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, h.v FROM own LEFT JOIN h USING (street_id) WHERE own.v IS NULL)"""


@query("assign_partition", f"WITH {_ASSIGN} SELECT coalesce(v, 'none') AS voivodeship_code, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM res GROUP BY ALL")
def assign_partition(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    two = lambda n: F.lpad((2 * n).cast("string"), 2, "0")
    code = F.when(F.col("l_linenumber") % 3 == 1, F.concat(two(F.col("c_nationkey") % 18), F.lit("01011"))).when(F.col("l_linenumber") % 3 == 2, F.concat(two(F.col("c_nationkey") % 16 + 1), F.lit("01011")))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("object_id"), F.col("l_partkey").cast("string").alias("street_id"), code.alias("municipality_code"))
    good, lost = quality.assign_partition(rows)
    both = good.select("voivodeship_code", "l_orderkey").unionByName(lost.select(F.lit("none").alias("voivodeship_code"), "l_orderkey"))
    return both.groupBy("voivodeship_code").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "installed_shards",
    """WITH c AS (SELECT lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') AS v, bool_or(event_type = 'click' AND event_id % 11 <> 0) AS done FROM events WHERE user_id % 40 < 20 AND (event_type <> 'click' OR user_id % 3 = 0) GROUP BY ALL),
p AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS v FROM customer) SELECT coalesce(c.v, p.v) AS voivodeship_code FROM c FULL JOIN p ON c.v = p.v WHERE coalesce(done, p.v IS NOT NULL)""",
)
def installed_shards(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id % 40 < 20 AND (event_type <> 'click' OR user_id % 3 = 0)")
    code = F.lpad((F.col("user_id") % 40).cast("string"), 2, "0")
    whole = F.col("event_type") == "click"
    cov = e.select(F.when(whole, "voivodeship").otherwise("county").alias("scope_type"), F.when(whole, code).otherwise(F.concat(code, F.lit("01"))).alias("scope_code"), F.when(F.col("event_id") % 11 == 0, "partial").otherwise("complete").alias("completeness"))
    present = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("voivodeship_code"))
    return quality.installed_shards(cov, present)


@query("page_after", "SELECT o_orderdate, o_orderkey, o_totalprice, 'OK' AS status FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-05-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def page_after(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return quality.page_after(o, ["o_orderdate", "o_orderkey"], [F.lit("1996-05-01"), F.lit(100)], 50, "v1", "v1")


@query(
    "page_set_check",
    """WITH p AS (SELECT conv_id AS dataset, CASE WHEN turn % 5 = 4 THEN 'unknown' ELSE CAST(count(*) OVER (PARTITION BY conv_id) + CASE WHEN conv_id % 5 = 0 THEN 1 WHEN conv_id % 7 = 0 THEN turn ELSE 0 END AS VARCHAR) END AS m, length(text) AS b FROM conversations),
s AS (SELECT dataset, count(DISTINCT CASE WHEN m <> 'unknown' THEN m END) AS totals, max(CASE WHEN m <> 'unknown' THEN CAST(m AS BIGINT) END) AS stated, count(*) AS n, sum(b) AS b FROM p GROUP BY dataset)
SELECT dataset, n AS rows, CAST(b AS BIGINT) AS bytes, CASE WHEN totals > 1 THEN 'TOTALS_DIFFER' WHEN totals = 1 AND stated <> n THEN 'ROWS_MISSING' ELSE 'OK' END AS status FROM s""",
)
def page_set_check(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    off = F.when(F.col("conv_id") % 5 == 0, 1).when(F.col("conv_id") % 7 == 0, F.col("turn")).otherwise(0)
    pages = c.select(F.col("conv_id").alias("dataset"), F.when(F.col("turn") % 5 == 4, "unknown").otherwise((F.col("n") + off).cast("string")).alias("matched"), F.lit(1).alias("rows"), F.length("text").alias("bytes"))
    return quality.check_page_set(pages)


@query(
    "file_set_check",
    r"""WITH f AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS base, (['shp', 'shx', 'dbf', 'prj', 'txt'])[page_id % 5 + 1] AS ext FROM pages),
g AS (SELECT DISTINCT split_part(base, '/', 2) AS base, (['shape', 'index', 'attributes', 'projection', 'x'])[list_position(['shp', 'shx', 'dbf', 'prj', 'txt'], ext)] AS role FROM f)
SELECT base, coalesce(string_agg(role, ',' ORDER BY role) FILTER (role <> 'x'), '') AS roles,
  array_to_string(list_filter(['attributes', 'index', 'projection', 'shape'], lambda r: NOT list_contains(list(role), r)), ',') AS missing,
  CASE WHEN count(*) FILTER (role = 'x') > 0 THEN 'UNSUPPORTED' WHEN count(*) < 4 THEN 'INCOMPLETE' ELSE 'OK' END AS status FROM g GROUP BY base""",
)
def file_set_check(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    base = F.split_part(F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^?#]*)", 1), F.lit("/"), F.lit(2))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("shp", "shx", "dbf", "prj", "txt")]), (F.col("page_id") % 5 + 1).cast("int"))
    return quality.check_file_sets(p.select(F.concat(base, F.lit("."), ext).alias("path")))


@query(
    "catalog_drift",
    """SELECT 'C' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'title' END AS "column", CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS expected,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name || '!' END AS actual FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 1
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'added', NULL, NULL, NULL FROM supplier""",
)
def catalog_drift(spark, sf_dir):
    n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    k = F.col("c_custkey")
    name = F.concat(F.lit("C"), k.cast("string"))
    expected = n.select(name.alias("name"), F.col("c_name").alias("title"), F.col("c_nationkey").cast("string").alias("crs"))
    actual = n.filter(k % 5 != 0).select(name.alias("name"), F.when(k % 7 == 1, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("title"), F.col("c_nationkey").cast("string").alias("crs"))
    more = r.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("title"), F.lit("0").alias("crs"))
    return quality.catalog_drift(expected, actual.unionByName(more), ["title", "crs"])


@query(
    "schema_drift",
    """WITH c AS (SELECT column_name AS name, column_index AS position FROM duckdb_columns() WHERE table_name = 'lineitem'),
v AS (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE value),
t AS (SELECT name, CASE WHEN bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'text' END AS type FROM v GROUP BY name)
SELECT 1 AS added, count(*) FILTER (name = 'l_returnflag') AS missing, 0 AS missing_critical, 0 AS type_changes, count(*) FILTER (position > (SELECT position FROM c WHERE name = 'l_returnflag')) AS moved, 'warning' AS verdict,
  (SELECT sha256('[' || string_agg('{"name":"' || name || '","type":"' || type || '","required":true}', ',' ORDER BY name) || ']') FROM t) AS fingerprint FROM c""",
)
def schema_drift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    altered = li.withColumn("l_tax", F.col("l_tax").cast("string")).drop("l_returnflag").withColumn("l_note", F.lit("x"))
    fields = written(quality.table_fields(li), "fields")
    drift = quality.schema_drift(fields, quality.table_fields(altered), ["l_orderkey"])
    return drift.crossJoin(quality.schema_fingerprint(fields))


@query(
    "layer_dimensions",
    "SELECT CAST(user_id % 54 AS INT) AS n, count(*) AS events FROM events GROUP BY ALL",
)
def layer_dimensions(spark, sf_dir):
    # events counted by the layer their user number falls on
    from pyspark.sql import Window

    layers = catalog.layers_table(spark).withColumn("n", F.row_number().over(Window.orderBy("layer_id")) - 1)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 54).cast("int").alias("n"))
    return e.join(F.broadcast(layers), "n").groupBy("n").agg(F.count(F.lit(1)).alias("events"))
