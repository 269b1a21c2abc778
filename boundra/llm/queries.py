"""Driver queries of the corpus operators, each over its whole table, and their SQL oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.llm.chat_format import format_turns, read_back, with_probe
from boundra.llm.collocations import collocations
from boundra.llm.common import table
from boundra.llm.decontaminate import contamination_report, find_contamination
from boundra.llm.exact_dedup import exact_dedup
from boundra.llm.html_text import extract_text
from boundra.llm.jaccard_join import similar_groups
from boundra.llm.language_id import fold, identify_language, train
from boundra.llm.license_scan import scan_licenses
from boundra.llm.sentencepiece_codec import encode_decode
from boundra.llm.token_counts import token_counts
from boundra.llm.toxicity import score_toxicity
from boundra.llm.toxicity import train as train_toxicity
from boundra.llm.vector_codes import compress_vectors
from boundra.llm.warc import archive_round_trip

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("spans")


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)
), p AS (
  SELECT doc_id, size, k, array_to_string(ws[k : k + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM i) WHERE len(ws) >= size)
), m AS (
  SELECT doc_id, item_id, k, p.size FROM p JOIN i USING (size, win)
), h AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM p
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    return identify_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + 3], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_turns(with_probe(table(spark, sf_dir, "conversations"))))


ORACLES["op11_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, '### ' || regexp_replace(role, '([\\:#<])', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\*(###|</turn>))', '\\\1', 'g') || ' </turn>' || chr(10) AS segment FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, words, count(*) AS f
  FROM (SELECT lang, size, ws[k : k + size - 1] AS words FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM p, (VALUES (1), (2), (3), (4), (5)) AS v(size) WHERE len(ws) >= size))
  GROUP BY lang, words HAVING count(*) >= 100
), inner_phrases AS (
  SELECT lang, words[b : e] AS words, max(f) AS f
  FROM (SELECT lang, words, f, b, unnest(range(b + 1, len(words) + 1)) AS e FROM (SELECT lang, words, f, unnest(range(1, len(words))) AS b FROM f WHERE len(words) > 2))
  WHERE e - b + 1 < len(words) GROUP BY ALL
), c AS (
  SELECT f.lang, f.words, f.f AS a FROM f LEFT JOIN inner_phrases i ON i.lang = f.lang AND i.words = f.words WHERE len(f.words) > 1 AND (i.f IS NULL OR 100 * i.f < 100 * f.f)
), cuts AS (
  SELECT c.lang, c.words, a, k, x.f AS l, y.f AS r, n, (1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c) c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1 :]
), best AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _vector_sql() -> str:
    """Parts as lists, codebooks as rows; each round is a nearest entry by inner products of whole numbers, exact in doubles."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM kept, (VALUES (0), (1), (2), (3)) AS q(part))",
        "b0 AS MATERIALIZED (SELECT part, e, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)",
    ]
    for k in range(5):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, nearest.e AS e, nearest.d AS d FROM (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.x) AS x, "
            f"min({{'d': list_inner_product(p.x, p.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x), 'e': b.e}}) AS nearest "
            f"FROM parts p JOIN b{k} b USING (part) GROUP BY p.vec_id, p.part))"
        )
        if k < 4:
            steps.append(f"m{k} AS (SELECT part, e, list(floor(s / n) ORDER BY place) AS x FROM (SELECT part, e, place, sum(y) AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS place FROM a{k}) GROUP BY ALL) GROUP BY part, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, e))")
    steps.append("codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)")
    steps.append("sha AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, sha"


ORACLES["op13_vector_codes"] = _vector_sql()
