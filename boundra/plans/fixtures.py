"""Register tables derived from the driver's tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.functions.geometry import position
from boundra.plans.registry import table

POINTS = "p AS (SELECT vec_id AS point_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 100000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * 100000) AS BIGINT) AS y FROM embeddings)"
AREAS = """keys AS (
  SELECT 'L01' AS layer_id, CAST(r_regionkey AS BIGINT) AS k, r_name AS name, 20000 AS base FROM region
  UNION ALL SELECT 'L02', CAST(n_nationkey AS BIGINT), n_name, 8000 FROM nation
  UNION ALL SELECT 'L03', s_suppkey, s_name, 2000 FROM supplier
), a AS (
  SELECT layer_id, CAST(k AS VARCHAR) AS object_id, name, k, (k * 7919) % 40000 - 20000 AS cx, (k * 10473) % 40000 - 20000 AS cy, base + 4 * ((k * 31) % 500) AS h FROM keys
)"""
#: Closed form of what the L-shaped areas with a hole cover.
COVERED = """((x BETWEEN cx - h AND cx + h AND y BETWEEN cy - h AND cy) OR (x BETWEEN cx - h AND cx AND y BETWEEN cy - h AND cy + h))
  AND NOT (k % 3 = 0 AND x > cx - h // 2 - h // 4 AND x < cx - h // 2 + h // 4 AND y > cy - h // 2 - h // 4 AND y < cy - h // 2 + h // 4)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda k: F.floor(F.get(e, k).cast("double") * 100000).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda k: F.floor(F.get(e, k).cast("double") * 100000).cast("double")
    ring = F.array(*[F.struct(at(2 * k).alias("x"), at(2 * k + 1).alias("y")) for k in range(8)])
    geom = F.struct(F.lit("LineString").alias("kind"), F.array(F.array(ring)).alias("parts"))
    return with_box(table(spark, sf_dir, "embeddings").select(F.lit("LX").alias("layer_id"), F.col("vec_id").cast("string").alias("object_id"), F.lit(1).cast("bigint").alias("snapshot_id"), F.explode(F.array(geom)).alias("geom")))


def with_box(df: DataFrame) -> DataFrame:
    from boundra.functions.geometry import bbox

    return df.withColumn("_b", bbox(F.col("geom"))).select("*", "_b.min_x", "_b.min_y", "_b.max_x", "_b.max_y").drop("_b")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped areas; exploding the geometry makes it a column of its own, as if it had been read."""
    def layer(name: str, key: str, label: str, code: str, base: int) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(code).alias("layer_id"), F.col(key).cast("bigint").alias("k"), F.col(label).alias("name"), F.lit(base).cast("bigint").alias("base"))

    keys = layer("region", "r_regionkey", "r_name", "L01", 20000).unionByName(layer("nation", "n_nationkey", "n_name", "L02", 8000)).unionByName(layer("supplier", "s_suppkey", "s_name", "L03", 2000))
    k = F.col("k")
    made = keys.select("layer_id", k.cast("string").alias("object_id"), "name", "k", (k * 7919 % 40000 - 20000).alias("cx"), (k * 10473 % 40000 - 20000).alias("cy"), (F.col("base") + 4 * (k * 31 % 500)).alias("h"))
    cx, cy, h = F.col("cx"), F.col("cy"), F.col("h")
    outer = F.array(*[position(x, y) for x, y in ((cx - h, cy - h), (cx + h, cy - h), (cx + h, cy), (cx, cy), (cx, cy + h), (cx - h, cy + h), (cx - h, cy - h))])
    hx, hy, q = cx - F.floor(h / 2), cy - F.floor(h / 2), F.floor(h / 4)
    hole = F.array(*[position(x, y) for x, y in ((hx - q, hy - q), (hx + q, hy - q), (hx + q, hy + q), (hx - q, hy + q), (hx - q, hy - q))])
    parts = F.array(F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)))
    box = {"min_x": cx - h, "min_y": cy - h, "max_x": cx + h, "max_y": cy + h}
    return made.withColumn("geom", F.explode(F.array(F.struct(F.lit("Polygon").alias("kind"), parts.alias("parts"))))).withColumns({n: v.cast("double") for n, v in box.items()}).withColumn("snapshot_id", F.lit(1).cast("bigint")).withColumn("code", F.lpad("object_id", 7, "0"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    suffix = F.when(key % 3 == 0, " A").when(key % 3 == 1, " / 7").otherwise("")
    number = F.concat((key % 200).cast("string"), suffix)
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_regionkey").cast("bigint").alias("shard"), key.cast("string").alias("object_id"), F.col("n_name").alias("locality_name"), F.col("c_mktsegment").alias("street_name"),
        number.alias("building_number"), F.lit(None).cast("string").alias("postal_code"), F.concat_ws(" ", "n_name", F.lit("ul."), "c_mktsegment", number).alias("text"), key,
    )


ADDRESSES = """ad AS (
  SELECT CAST(n_regionkey AS BIGINT) AS shard, CAST(c_custkey AS VARCHAR) AS object_id, n_name AS locality_name, c_mktsegment AS street_name, c_custkey,
         CAST(c_custkey % 200 AS VARCHAR) || CASE c_custkey % 3 WHEN 0 THEN ' A' WHEN 1 THEN ' / 7' ELSE '' END AS building_number
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), addresses AS (
  SELECT *, locality_name || ' ul. ' || street_name || ' ' || building_number AS text FROM ad
)"""


def polish_sql(c: str) -> str:
    """The Polish search form in DuckDB, where a word boundary is ASCII-only as it should be."""
    out = rf"regexp_replace(lower({c}), '\b([0-9]{{2}})-([0-9]{{3}})\b', '\1\2', 'g')"
    out = f"translate({out}, 'ąćęłńóśźż', 'acelnoszz')"
    for short, whole in (("ul|ulica", "ulica"), ("al|aleja", "aleja"), ("pl|plac", "plac")):
        out = rf"regexp_replace({out}, '\b(?:{short})\.?\b', ' {whole} ', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}/]+', ' ', 'g'))"
    out = f"regexp_replace({out}, ' */ *', '/', 'g')"
    for _ in range(2):  # a match takes the blank that the next one needs
        out = rf"regexp_replace({out}, '(^| )([0-9/]*[0-9][0-9/]*) ([a-z])( |$)', '\1\2\3\4', 'g')"
    return out
