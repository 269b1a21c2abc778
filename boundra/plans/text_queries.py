"""Driver queries of text normalisation, matching and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundra.functions.ids import encode_id, parse_properties
from boundra.functions.sql import register_functions
from boundra.functions.text import classify_match, normalize_area, normalize_polish, remove_street_kind, tokens
from boundra.operators.search import match_structured, search_addresses, search_areas, search_streets, text_search
from boundra.operators.search_index import add_documents, remove_documents, search_index
from boundra.operators.snapshots import filter_areas as filter_areas_op
from boundra.operators.spatial import top_k
from boundra.plans import fixtures as fx
from boundra.plans.registry import query, table
from boundra.sources.storage import shared_path


@query(
    "normalize_polish",
    rf"""WITH {fx.ADDRESSES}
SELECT 'a' || object_id AS id, {fx.polish_sql("text")} AS norm FROM addresses
UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), {fx.polish_sql("text")} FROM documents""",
)
def q_normalize_polish(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return (
        fx.addresses(spark, sf_dir).select(F.concat(F.lit("a"), "object_id").alias("id"), normalize_polish(F.col("text")).alias("norm"))
        .unionByName(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), normalize_polish(F.col("text")).alias("norm")))
    )


@query(
    "normalize_area",
    r"""SELECT doc_id, trim(regexp_replace(lower(replace(replace(strip_accents(regexp_replace(text, '[\^`¨¯´·¸]', '', 'g')), 'ł', 'l'), 'Ł', 'L')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents""",
)
def q_normalize_area(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_area(F.col("text")).alias("norm"))


_PAIRS = f"""WITH {fx.ADDRESSES}, n AS (SELECT c_custkey, {fx.polish_sql("text")} AS norm FROM addresses), m AS (
  SELECT x.c_custkey, CASE x.c_custkey % 6 WHEN 0 THEN x.norm WHEN 1 THEN substr(x.norm, 1, 12) WHEN 2 THEN substr(x.norm, 4, 9)
    WHEN 3 THEN split_part(x.norm, ' ', 1) || ' ' || split_part(x.norm, ' ', 3) || ' ' || split_part(x.norm, ' ', 4)
    WHEN 4 THEN substr(x.norm, 1, 5) || 'x' || substr(x.norm, 7) ELSE split_part(x.norm, ' ', 3) || ' ' || substr(x.norm, 1, 6) END AS q, x.norm AS c FROM n x
), t AS (
  SELECT *, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}/]+') AS qt, regexp_extract_all(c, '[\\p{{L}}\\p{{N}}/]+') AS ct, levenshtein(q, c) AS far FROM m
), o AS (
  SELECT *, len(list_filter(qt, lambda a: len(list_filter(ct, lambda b: starts_with(b, a))) = 0)) = 0 AS covered, regexp_matches(' ' || array_to_string(ct, '  ') || ' ', ' ' || array_to_string(qt, ' .* ') || ' ') AS ordered FROM t
)
SELECT c_custkey, CASE WHEN q = c THEN 'exact' WHEN length(q) >= 2 AND starts_with(c, q) THEN 'prefix' WHEN length(q) >= 3 AND contains(c, q) THEN 'contains' WHEN ordered OR covered THEN 'contains'
    WHEN far <= 2 AND 1 - far / greatest(length(q), length(c)) >= 0.78 THEN 'fuzzy' ELSE 'none' END AS mode,
  round(CASE WHEN q = c THEN 1 WHEN length(q) >= 2 AND starts_with(c, q) THEN 0.9 WHEN length(q) >= 3 AND contains(c, q) THEN 0.75 WHEN ordered THEN 0.72 WHEN covered THEN 0.68
    WHEN far <= 2 AND 1 - far / greatest(length(q), length(c)) >= 0.78 THEN 1 - far / greatest(length(q), length(c)) ELSE 0 END::DOUBLE, 9) AS confidence,
  trim(regexp_replace(regexp_replace(' ' || array_to_string(ct, '  ') || ' ', ' (ulica|aleja|plac|rondo|osiedle) ', ' ', 'g'), ' +', ' ', 'g')) AS bare
FROM o""".replace("\\\\", "\\")


def _pairs(spark, sf_dir):
    """Addresses c, and queries q that are equal, begin, lie in, are in order, are misspelled or cover."""
    n = fx.addresses(spark, sf_dir).select("c_custkey", normalize_polish(F.col("text")).alias("c"))
    w = lambda k: F.split_part("c", F.lit(" "), F.lit(k))
    k = F.col("c_custkey") % 6
    q = (
        F.when(k == 0, F.col("c")).when(k == 1, F.substring("c", 1, 12)).when(k == 2, F.substring("c", 4, 9))
        .when(k == 3, F.concat_ws(" ", w(1), w(3), w(4))).when(k == 4, F.concat(F.substring("c", 1, 5), F.lit("x"), F.expr("substring(c, 7)")))
        .otherwise(F.concat(w(3), F.lit(" "), F.substring("c", 1, 6)))
    )
    return n.withColumn("q", q)


@query("classify_match", _PAIRS)
def q_classify_match(spark, sf_dir):
    m = _pairs(spark, sf_dir).withColumn("m", classify_match(F.col("q"), F.col("c")))
    return m.select("c_custkey", "m.mode", F.round("m.confidence", 9).alias("confidence"), remove_street_kind(F.col("c")).alias("bare"))


@query("sql_functions_match", _PAIRS)
def sql_functions_match(spark, sf_dir):
    """As classify_match, by the SQL functions."""
    register_functions(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("boundra_pairs")
    return spark.sql("SELECT c_custkey, m.mode, round(m.confidence, 9) AS confidence, remove_street_kind(c) AS bare FROM (SELECT c_custkey, c, classify_match(q, c) AS m FROM boundra_pairs)")


def _bm25_sql(docs: str, queries: str) -> str:
    """BM25 over ``docs`` (part, doc, w1: list of {token, w}, length) and ``queries`` (request_id, words)."""
    return f"""{docs}, {queries},
st AS (SELECT part, count(*) AS n_docs, avg(length) AS mean_length FROM docs GROUP BY part),
tok AS (SELECT part, doc, length, t.token AS token, t.w AS w FROM (SELECT part, doc, length, unnest(listed) AS t FROM docs)),
po AS MATERIALIZED (SELECT part, doc, length, token, sum(w) AS f FROM tok GROUP BY ALL),
qw AS (SELECT request_id, len(words) AS n_words, generate_subscripts(words, 1) AS place, unnest(words) AS word FROM queries),
hit AS MATERIALIZED (SELECT word, part, doc, length, sum(f) AS f FROM (SELECT DISTINCT word FROM qw) JOIN po ON starts_with(token, word) GROUP BY ALL),
df AS (SELECT word, part, count(*) AS n FROM hit GROUP BY ALL),
full_ AS (SELECT qw.request_id, part, doc FROM qw JOIN hit USING (word) GROUP BY qw.request_id, part, doc, n_words HAVING count(*) = n_words),
sc AS (
  SELECT request_id, part, doc, -sum(CASE WHEN ln((n_docs - n + 0.5e0) / (n + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5e0) / (n + 0.5e0)) END * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * length / mean_length))) AS bm25
  FROM full_ JOIN qw USING (request_id) JOIN hit USING (word, part, doc) JOIN df USING (word, part) JOIN st USING (part) GROUP BY ALL
)"""


_BM25 = (
    "WITH "
    + _bm25_sql(
        r"""docs AS (SELECT 0 AS part, doc_id AS doc, len(ws) AS length, list_transform(ws, lambda x: {'token': x, 'w': 1e0}) AS listed FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents))""",
        r"""queries AS (SELECT item_id AS request_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words FROM benchmark)""",
    )
    + " SELECT request_id, doc AS doc_id, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(bm25, 9), doc) AS rank FROM sc) WHERE rank <= 10"
)


def _bm25_tables(spark, sf_dir):
    """Documents, and as requests all distinct words of each item."""
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("part"), "doc_id", "text")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.array_distinct(tokens(F.lower("text"))).alias("words"))


@query("bm25_topk_documents", _BM25)
def bm25_topk_documents(spark, sf_dir):
    """From a stored index, which is built here, so that the work includes it."""
    docs, asked = _bm25_tables(spark, sf_dir)
    root = shared_path(spark, "index")
    add_documents(docs, root, "part", "doc_id", {"text": 1.0})
    return search_index(asked, root, 10).select("request_id", F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query("bm25_topk_whole_texts", _BM25)
def bm25_topk_whole_texts(spark, sf_dir):
    """As bm25_topk_documents, without an index: every match is scored."""
    docs, asked = _bm25_tables(spark, sf_dir)
    best = top_k(text_search(asked, docs, "part", "doc_id", {"text": 1.0}), ["request_id"], [F.round("bm25", 9), F.col("doc")], 10)
    return best.select("request_id", F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(
    "search_index_segments",
    f"WITH {fx.ADDRESSES}, "
    + _bm25_sql(
        r"""ts AS (SELECT *, regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}]+') AS ws FROM addresses WHERE c_custkey % 5 <> 0),
docs AS (SELECT shard AS part, object_id AS doc, len(ws) AS length, list_transform(ws, lambda x: {'token': x, 'w': 1e0}) AS listed FROM ts)""",
        r"""queries AS (SELECT c_mktsegment AS request_id, [substr(lower(c_mktsegment), 1, 4), 'ul'] AS words FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT n_name, regexp_extract_all(lower(n_name), '[\p{L}\p{N}]+') FROM nation)""",
    )
    + " SELECT request_id, part AS shard, doc AS object_id, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(bm25, 9), doc, part) AS rank FROM sc) WHERE rank <= 10",
)
def search_index_segments(spark, sf_dir):
    """An index through its life: a first segment, addresses replaced by a second, some removed."""
    a = fx.addresses(spark, sf_dir)
    k, root = F.col("c_custkey"), shared_path(spark, "index")
    add_documents(a.filter(k % 3 != 0).withColumn("text", F.when(k % 3 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))), root, "shard", "object_id", {"text": 1.0})
    add_documents(a.filter(k % 3 != 2), root, "shard", "object_id", {"text": 1.0})
    remove_documents(a.filter(k % 5 == 0).select(F.col("shard").alias("part"), F.col("object_id").alias("doc")), root)
    segment = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    asked = segment.select(F.col("c_mktsegment").alias("request_id"), F.array(F.expr("substring(lower(c_mktsegment), 1, 4)"), F.lit("ul")).alias("words"))
    asked = asked.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("request_id"), tokens(F.lower("n_name")).alias("words")))
    return search_index(asked, root, 10).select("request_id", F.col("part").alias("shard"), F.col("doc").alias("object_id"), F.round("bm25", 6).alias("bm25"), "rank")


def _named_areas(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = lambda name, key, label, layer: table(spark, sf_dir, name).select(F.lit(layer).alias("layer_id"), F.col(key).cast("string").alias("object_id"), F.col(label).alias("name"), F.lpad(F.col(key).cast("string"), 7, "0").alias("code"), none.alias("aliases"))
    return part("region", "r_regionkey", "r_name", "L01").unionByName(part("nation", "n_nationkey", "n_name", "L02")).unionByName(part("part", "p_partkey", "p_name", "L04"))


_NAMED = """named AS (
  SELECT 'L01' AS layer_id, CAST(r_regionkey AS VARCHAR) AS object_id, r_name AS name, lpad(CAST(r_regionkey AS VARCHAR), 7, '0') AS code FROM region
  UNION ALL SELECT 'L02', CAST(n_nationkey AS VARCHAR), n_name, lpad(CAST(n_nationkey AS VARCHAR), 7, '0') FROM nation
  UNION ALL SELECT 'L04', CAST(p_partkey AS VARCHAR), p_name, lpad(CAST(p_partkey AS VARCHAR), 7, '0') FROM part
), asked AS (
  SELECT DISTINCT substr(p_name, 1, 3) || substr(p_name, instr(p_name, ' ')) AS query FROM part
  UNION SELECT name FROM named WHERE layer_id <> 'L04' UNION SELECT code FROM named WHERE layer_id = 'L02'
)"""


def _area_requests(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, instr(p_name, ' '))")).alias("query"))
    a = _named_areas(spark, sf_dir)
    return p.union(a.filter("layer_id <> 'L04'").select("name")).union(a.filter("layer_id = 'L02'").select("code")).distinct().select(F.col("query").alias("request_id"), "query")


@query(
    "search_areas_ranked",
    f"WITH {_NAMED}, "
    + _bm25_sql(
        r"""nn AS (SELECT *, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM named),
ts AS (SELECT *, regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS t1, regexp_extract_all(normalized, '[\p{L}\p{N}]+') AS t2, regexp_extract_all(lower(code), '[\p{L}\p{N}]+') AS t3 FROM nn),
docs AS (SELECT 0 AS part, layer_id || chr(1) || object_id AS doc, len(t1) + len(t2) + len(t3) AS length,
  list_concat(list_transform(t1, lambda x: {'token': x, 'w': 5e0}), list_concat(list_transform(t2, lambda x: {'token': x, 'w': 4e0}), list_transform(t3, lambda x: {'token': x, 'w': 3e0}))) AS listed FROM ts)""",
        r"""aq AS (SELECT query, trim(regexp_replace(lower(query), '[^\p{L}\p{N}]+', ' ', 'g')) AS q FROM asked),
queries AS (SELECT query AS request_id, regexp_extract_all(q, '[\p{L}\p{N}]+') AS words FROM aq)""",
    )
    + """, b AS (
  SELECT request_id, layer_id, object_id, name, bm25, CASE WHEN lower(code) = lower(trim(request_id)) THEN 0 WHEN normalized = q THEN 1 WHEN starts_with(normalized, q) THEN 2 ELSE 3 END AS bucket
  FROM sc JOIN nn ON doc = layer_id || chr(1) || object_id JOIN aq ON query = request_id
) SELECT request_id, rank, layer_id, object_id, name, bucket, round(bm25, 6) AS bm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY bucket, round(bm25, 9), layer_id, lower(name), object_id) AS rank FROM b) WHERE rank <= 20""",
)
def search_areas_ranked(spark, sf_dir):
    return search_areas(_area_requests(spark, sf_dir), _named_areas(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))


@query(
    "search_addresses_structured",
    f"""WITH {fx.ADDRESSES}, n AS (SELECT *, lower(replace(locality_name, '_', ' ')) AS l, lower(street_name) AS s, {fx.polish_sql("building_number")} AS b FROM addresses),
q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN l END AS ql, CASE WHEN c_custkey % 3 <> 1 THEN s END AS qs, b AS qb FROM n),
m AS (SELECT request_id, shard, object_id, locality_name, street_name, building_number FROM q JOIN n ON qb = b AND (ql IS NULL OR ql = l) AND (qs IS NULL OR qs = s)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY lower(locality_name), lower(street_name), lower(building_number), object_id) AS rank FROM m)
SELECT request_id, shard, object_id, locality_name, street_name, building_number, rank FROM r WHERE rank <= 20""",
)
def search_addresses_structured(spark, sf_dir):
    a = fx.addresses(spark, sf_dir)
    k = F.col("c_custkey")
    asked = a.select(k.alias("request_id"), F.when(k % 2 == 0, F.col("locality_name")).alias("locality"), F.when(k % 3 != 1, F.col("street_name")).alias("street"), F.col("building_number").alias("number"), F.lit(None).cast("string").alias("postal"))
    return match_structured(asked, a)


_ADDRESS_REQUESTS = f"""aq AS (SELECT c_custkey AS request_id, {fx.polish_sql("CASE c_custkey % 3 WHEN 0 THEN text WHEN 1 THEN locality_name || ' ' || street_name ELSE street_name || ' ' || building_number END")} AS q FROM addresses)"""


def _address_requests(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.concat_ws(" ", "locality_name", "street_name")).otherwise(F.concat_ws(" ", "street_name", "building_number"))
    return fx.addresses(spark, sf_dir).select(k.alias("request_id"), text.alias("query"))


_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


@query(
    "search_addresses_ranked",
    f"WITH {fx.ADDRESSES}, "
    + _bm25_sql(
        rf"""nn AS (SELECT shard, object_id, {fx.polish_sql("locality_name || ' ulica ' || street_name || ' ' || building_number")} AS full_,
  {fx.polish_sql("locality_name || ' ' || street_name || ' ' || building_number")} AS f1, {fx.polish_sql("locality_name")} AS f2, {fx.polish_sql("street_name")} AS f3, {fx.polish_sql("building_number")} AS f4 FROM addresses),
ts AS (SELECT *, {_TOKENS.format("f1")} AS t1, {_TOKENS.format("f2")} AS t2, {_TOKENS.format("f3")} AS t3, {_TOKENS.format("f4")} AS t4 FROM nn),
docs AS (SELECT shard AS part, object_id AS doc, len(t1) + len(t2) + len(t3) + len(t4) AS length, list_concat(list_concat(list_transform(t1, lambda x: {{'token': x, 'w': 6e0}}), list_transform(t2, lambda x: {{'token': x, 'w': 4e0}})),
  list_concat(list_transform(t3, lambda x: {{'token': x, 'w': 4e0}}), list_transform(t4, lambda x: {{'token': x, 'w': 3e0}}))) AS listed FROM ts)""",
        _ADDRESS_REQUESTS + f""", queries AS (SELECT request_id, {_TOKENS.format("q")} AS words FROM aq)""",
    )
    + r""", c0 AS (SELECT sc.*, q, full_, replace(full_, 'ulica ', '') AS bare FROM sc JOIN nn ON part = shard AND doc = object_id JOIN aq USING (request_id)),
c1 AS (SELECT request_id, part, doc, bm25, unnest([full_, bare]) AS c, q FROM c0),
c2 AS (SELECT *, regexp_extract_all(q, '[\p{L}\p{N}/]+') AS qt, regexp_extract_all(c, '[\p{L}\p{N}/]+') AS ct, levenshtein(q, c) AS far FROM c1),
c3 AS (SELECT *, len(list_filter(qt, lambda a: len(list_filter(ct, lambda b: starts_with(b, a))) = 0)) = 0 AS covered, regexp_matches(' ' || array_to_string(ct, '  ') || ' ', ' ' || array_to_string(qt, ' .* ') || ' ') AS ordered FROM c2),
c4 AS (SELECT *, CASE WHEN q = c THEN 0 WHEN starts_with(c, q) THEN 1 WHEN contains(c, q) OR ordered OR covered THEN 2 WHEN far <= 2 AND 1 - far / greatest(length(q), length(c)) >= 0.78 THEN 3 ELSE 4 END AS w,
  CASE WHEN q = c THEN 1 WHEN starts_with(c, q) THEN 0.9 WHEN contains(c, q) THEN 0.75 WHEN ordered THEN 0.72 WHEN covered THEN 0.68 WHEN far <= 2 AND 1 - far / greatest(length(q), length(c)) >= 0.78 THEN 1 - far / greatest(length(q), length(c)) ELSE 0 END::DOUBLE AS conf FROM c3),
c5 AS (SELECT request_id, part, doc, bm25, w, conf FROM c4 QUALIFY row_number() OVER (PARTITION BY request_id, part, doc ORDER BY w, conf DESC) = 1),
c6 AS (SELECT *, row_number() OVER (PARTITION BY request_id, part ORDER BY bm25, doc) AS place FROM c5),
cap AS (SELECT request_id, part, max(place) AS n, [sum(CASE WHEN w < 4 AND place <= 100 * power(2, i) THEN 1 ELSE 0 END) FOR i IN [0]] AS unused FROM c6 GROUP BY ALL),
ok AS (SELECT c6.* FROM c6 WHERE w < 4),
s1 AS (SELECT *, row_number() OVER (PARTITION BY request_id, part ORDER BY w, conf DESC, round(bm25, 9), doc) AS r1 FROM ok),
s2 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY w, conf DESC, round(bm25, 9), doc) AS rank FROM s1 WHERE r1 <= 20)
SELECT request_id, rank, part AS shard, doc AS object_id, (['exact', 'prefix', 'contains', 'fuzzy', 'none'])[w + 1] AS mode, round(conf, 9) AS confidence, round(bm25, 6) AS bm25 FROM s2 WHERE rank <= 20""".replace(
        "cap AS (SELECT request_id, part, max(place) AS n, [sum(CASE WHEN w < 4 AND place <= 100 * power(2, i) THEN 1 ELSE 0 END) FOR i IN [0]] AS unused FROM c6 GROUP BY ALL),\n",
        """cap AS (SELECT request_id, part, max(place) AS n, sum(CASE WHEN w < 4 AND place <= 100 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN w < 4 AND place <= 200 THEN 1 ELSE 0 END) AS h2,
  sum(CASE WHEN w < 4 AND place <= 400 THEN 1 ELSE 0 END) AS h3, sum(CASE WHEN w < 4 AND place <= 800 THEN 1 ELSE 0 END) AS h4 FROM c6 GROUP BY ALL),\n""",
    ).replace(
        "ok AS (SELECT c6.* FROM c6 WHERE w < 4),",
        "ok AS (SELECT c6.* FROM c6 JOIN cap USING (request_id, part) WHERE w < 4 AND place <= CASE WHEN h1 >= 20 OR n < 100 THEN 100 WHEN h2 >= 20 OR n < 200 THEN 200 WHEN h3 >= 20 OR n < 400 THEN 400 WHEN h4 >= 20 OR n < 800 THEN 800 ELSE 1600 END),",
    ),
)
def search_addresses_ranked(spark, sf_dir):
    found = search_addresses(_address_requests(spark, sf_dir), fx.addresses(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 9)).withColumn("bm25", F.round("bm25", 6))


@query(
    "search_streets_ranked",
    "WITH st0 AS (SELECT p_partkey % 4 AS shard, CAST(p_partkey AS VARCHAR) AS object_id, p_name AS name, lower(p_name) AS normalized FROM part), "
    + _bm25_sql(
        rf"""ts AS (SELECT *, {_TOKENS.format("normalized")} AS t1 FROM st0),
docs AS (SELECT shard AS part, object_id AS doc, 2 * len(t1) AS length, list_transform(t1, lambda x: {{'token': x, 'w': 10e0}}) AS listed FROM ts)""",
        rf"""aq AS (SELECT DISTINCT p_name AS request_id, 'ulica ' || substr(p_name, 1, length(p_name) - 1) AS q, substr(p_name, 1, length(p_name) - 1) AS bare FROM part),
queries AS (SELECT request_id, {_TOKENS.format("bare")} AS words FROM aq)""",
    )
    + r""", m AS (SELECT sc.*, name, CASE WHEN normalized = bare THEN 0 WHEN starts_with(normalized, bare) THEN 1 WHEN contains(normalized, bare) THEN 2 ELSE 4 END AS w FROM sc JOIN st0 ON part = shard AND doc = object_id JOIN aq USING (request_id)),
c6 AS (SELECT *, row_number() OVER (PARTITION BY request_id, part ORDER BY bm25, doc) AS place FROM m),
ok AS (SELECT * FROM c6 WHERE w < 4 AND place <= 100)
SELECT request_id, rank, part AS shard, doc AS object_id, name, (['exact', 'prefix', 'contains'])[w + 1] AS mode, ([1, 0.9, 0.75]::DOUBLE[])[w + 1] AS confidence, round(bm25, 6) AS bm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY w, round(bm25, 9), doc) AS rank FROM ok) WHERE rank <= 20""",
)
def search_streets_ranked(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    streets = p.select((F.col("p_partkey") % 4).alias("shard"), F.col("p_partkey").cast("string").alias("object_id"), F.col("p_name").alias("name"))
    asked = p.select("p_name").distinct().select(F.col("p_name").alias("request_id"), F.concat(F.lit("ul. "), F.expr("substring(p_name, 1, length(p_name) - 1)")).alias("query"))
    return search_streets(asked, streets).withColumn("bm25", F.round("bm25", 6))


@query(
    "filter_areas",
    f"""WITH {_NAMED}, q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_custkey % 40 AS VARCHAR), 7, '0') END AS qc, CASE WHEN o_orderkey % 2 = 0 THEN 'L0' || CAST(o_orderkey % 5 AS VARCHAR) END AS ql FROM orders),
m AS (SELECT request_id, layer_id, object_id, name FROM q JOIN named ON (qc IS NOT NULL OR ql IS NOT NULL) AND (qc IS NULL OR qc = code) AND (ql IS NULL OR ql = layer_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY layer_id, lower(name), object_id) AS rank FROM m)
SELECT request_id, rank, layer_id, object_id, name FROM r WHERE rank <= 20""",
)
def q_filter_areas(spark, sf_dir):
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 3 != 0, F.lpad((F.col("o_custkey") % 40).cast("string"), 7, "0")).alias("code"), F.when(k % 2 == 0, F.concat(F.lit("L0"), (k % 5).cast("string"))).alias("layer_id"))
    return filter_areas_op(_named_areas(spark, sf_dir), asked)


@query(
    "lookup_by_id",
    f"""WITH {fx.ADDRESSES} SELECT c_custkey AS request_id,
  CASE c_custkey % 5 WHEN 3 THEN 'not_found' WHEN 4 THEN 'invalid_id' ELSE 'found' END AS status, CASE WHEN c_custkey % 5 < 3 THEN object_id END AS object_id, CASE WHEN c_custkey % 5 < 3 THEN text END AS text,
  CASE WHEN c_custkey % 2 = 0 THEN object_id END AS property FROM addresses""",
)
def lookup_by_id(spark, sf_dir):
    from boundra.operators.lookup import lookup

    a = fx.addresses(spark, sf_dir)
    k = F.col("c_custkey")
    good = encode_id(voivodeshipCode=F.col("shard").cast("string"), objectId=F.col("object_id"))
    missing = encode_id(voivodeshipCode=F.lit("9"), objectId=F.col("object_id"))
    asked = a.select(k.alias("request_id"), F.when(k % 5 == 3, missing).when(k % 5 == 4, F.lit("no id!")).otherwise(good).alias("id"), F.when(k % 2 == 0, F.to_json(F.struct(F.col("object_id").alias("k")))).otherwise("[1]").alias("json"))
    held = a.select(F.col("shard").cast("string").alias("voivodeshipCode"), F.col("object_id").alias("objectId"), "object_id", "text")
    found = lookup(asked, held, "voivodeshipCode string, objectId string", ["voivodeshipCode", "objectId"])
    return found.select("request_id", "status", "object_id", "text", parse_properties(F.col("json"))["k"].alias("property"))


@query(
    "sql_functions",
    f"""WITH {fx.ADDRESSES} SELECT c_custkey, {fx.polish_sql("text")} AS norm, sqrt(c_custkey * c_custkey + 16e0) AS distance,
  CASE WHEN c_custkey % 100 BETWEEN 2 AND 32 AND c_custkey % 2 = 0 THEN 'voivodeship' END AS scope FROM addresses""",
)
def sql_functions(spark, sf_dir):
    register_functions(spark)
    fx.addresses(spark, sf_dir).createOrReplaceTempView("boundra_addresses")
    return spark.sql(
        "SELECT c_custkey, normalize_polish(text) AS norm, distance(0, 0, c_custkey, 4) AS distance, parse_scope(lpad(cast(c_custkey % 100 AS string), 2, '0')).type AS scope FROM boundra_addresses"
    )


