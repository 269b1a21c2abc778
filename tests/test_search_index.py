"""The stored index against a search that scores everything, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from boundra.functions.text import tokens
from boundra.operators import search_index as si
from boundra.operators.search import text_search
from boundra.operators.spatial import top_k
from boundra.sources.manifest import Conflict, Manifest
from boundra.sources.storage import shared_path

WORDS = ["ulica", "ul", "polna", "polny", "lesna", "las", "a", "ab", "abc", "nowa", "łąka", "x9", "zz"]


def docs_of(r, ids):
    return [(i % 2, f"d{i}", " ".join(r.choices(WORDS, [9, 5, 3, 3, 2, 2, 6, 2, 2, 3, 1, 1, 1], k=r.randint(1, 40)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "part int, doc string, text string")


def asked(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "request_id int, q string").select("request_id", tokens(F.col("q")).alias("words"))


QUERIES = ["ul", "polna", "po la", "a", "abc nowa", "łąka ulica las", "zz zz", "nothing", "q ul", "x", "ul ul a"]


def full(spark, rows, k):
    best = top_k(text_search(asked(spark, QUERIES), frame(spark, rows), "part", "doc", {"text": 2.0}), ["request_id"], [F.round("bm25", 9), F.col("doc"), F.col("part")], k)
    return sorted((x.request_id, x.rank, x.part, x.doc, round(x.bm25, 7)) for x in best.collect())


def stored(spark, root, k):
    return sorted((x.request_id, x.rank, x.part, x.doc, round(x.bm25, 7)) for x in si.search_index(asked(spark, QUERIES), root, k).collect())


def test_index_through_its_life(spark):
    """Built, added to, replaced, removed from and merged, it finds what a search of the rows finds."""
    r, root = random.Random(1), shared_path(spark, "index")
    rows = {d[:2]: d for d in docs_of(r, range(900))}
    si.add_documents(frame(spark, list(rows.values())), root, "part", "doc", {"text": 2.0})
    assert stored(spark, root, 5) == full(spark, list(rows.values()), 5)
    more = docs_of(r, range(800, 1100))
    rows |= {d[:2]: d for d in more}
    si.add_documents(frame(spark, more), root, "part", "doc", {"text": 2.0})
    gone = [d for d in rows if int(d[1][1:]) % 7 == 0]
    for d in gone:
        rows.pop(d)
    version = si.remove_documents(spark.createDataFrame([*gone, (0, "unknown")], "part int, doc string"), root)
    assert si.remove_documents(spark.createDataFrame([(0, "unknown")], "part int, doc string"), root) == version == 3
    wanted = full(spark, list(rows.values()), 5)
    assert stored(spark, root, 5) == wanted
    assert si.merge_segments(spark, root) == 4 and len(Manifest(spark, root).read()[1]["segments"]) == 1
    assert stored(spark, root, 5) == wanted
    with pytest.raises(Conflict):
        Manifest(spark, root).commit(3, {})


def test_common_words_score_few_documents(spark):
    r, root = random.Random(2), shared_path(spark, "index")
    rows = [(0, f"d{i}", " ".join(["the"] * r.randint(1, 3) + [r.choice("bcdefgh") * 3 for _ in range(r.randint(3, 400))])) for i in range(12_000)]
    df = frame(spark, rows)
    si.add_documents(df, root, "part", "doc", {"text": 1.0})
    q = asked(spark, ["the", "th bbb"])
    found = si.search_index(q, root, 10, scored=True).collect()
    every = top_k(text_search(q, df, "part", "doc", {"text": 1.0}), ["request_id"], [F.round("bm25", 9), F.col("doc")], 10)
    assert sorted((x.request_id, x.rank, x.doc) for x in found) == sorted((x.request_id, x.rank, x.doc) for x in every.collect())
    share = {x.request_id: x.postings / x.matches for x in found}
    assert share[0] < 0.1 and share[1] < 0.1, share


def test_a_search_reads_the_buckets_of_its_words(spark):
    r, root = random.Random(3), shared_path(spark, "index")
    si.add_documents(frame(spark, docs_of(r, range(200))), root, "part", "doc", {"text": 1.0})
    path = f"{root}/{Manifest(spark, root).read()[1]['segments'][0]}/blocks"
    every = spark.read.parquet(path)
    one = every.filter(F.col("bucket").isin([every.filter("token = 'polna'").first().bucket]))
    read = {f.rsplit("/", 2)[-2] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert len(read) == 1 < len({f.rsplit("/", 2)[-2] for f in every.inputFiles()})


def test_an_index_is_smaller_than_its_texts(spark, tmp_path, monkeypatch):
    """Postings are written once and without the documents' ids, and texts aren't written beside them; blocks that tasks make at once, or that lie in two parts, are whole."""
    r, root, names, plain = random.Random(4), f"{tmp_path}/i", [], si.written
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(4, 9))) for _ in range(3000)]
    rows = [(i % 3, f"document-{i:09d}", " ".join(vocabulary[min(int(r.expovariate(0.004)), 2999)] for _ in range(r.randint(1, 600)))) for i in range(1500)]
    monkeypatch.setattr(si, "AT_ONCE", 5000, raising=False)
    monkeypatch.setattr(si, "written", lambda df, name: (names.append(name), plain(df, name))[1])
    si.add_documents(frame(spark, rows), root, "part", "doc", {"text": 1.0})
    assert not names
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.4 * sum(len(x[2]) for x in rows)
    q = asked(spark, [vocabulary[k][:n] for k in (0, 5, 400, 900) for n in (1, 3, 9)] + [f"{vocabulary[1]} {vocabulary[2]} {vocabulary[3][:2]}"])
    every = top_k(text_search(q, frame(spark, rows), "part", "doc", {"text": 1.0}), ["request_id"], [F.round("bm25", 9), F.col("doc")], 10)
    wanted = sorted((x.request_id, x.rank, x.doc, round(x.bm25, 7)) for x in every.collect())
    assert sorted((x.request_id, x.rank, x.doc, round(x.bm25, 7)) for x in si.search_index(q, root, 10).collect()) == wanted
    monkeypatch.setattr(si, "SENT", 0)  # as with more words than are sent to all tasks
    assert sorted((x.request_id, x.rank, x.doc, round(x.bm25, 7)) for x in si.search_index(q, root, 10).collect()) == wanted


def test_any_hits_and_any_shares_of_buckets_come_back(spark):
    """Hits that aren't a byte, tokens of any letters, more shares than one of each bucket, and nothing at all."""
    r, root = random.Random(5), shared_path(spark, "index")
    common = [(0, f"d{i}", "ul " * r.choice([1, 2, 700]) + " ".join(r.choices(["łąka", "𝔘lica", "a", "straße", "東京"], k=5))) for i in range(150)]
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        si.add_documents(frame(spark, common), root, "part", "doc", {"text": 0.3})
        si.add_documents(frame(spark, []), root, "part", "doc", {"text": 0.3})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    path = f"{root}/{Manifest(spark, root).read()[1]['segments'][0]}"
    hits = {(x.token, x.f): x.n for x in spark.read.parquet(f"{path}/blocks").select("token", F.explode("fs").alias("f")).groupBy("token", F.round("f", 6).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {}
    for _, _, text in common:
        for t in set(text.lower().split()):
            key = (t, round(0.3 * text.lower().split().count(t), 6))
            wanted[key] = wanted.get(key, 0) + 1
    assert hits == wanted
    q = asked(spark, ["ul", "łą", "𝔘lica ul", "東京 straße"])
    every = top_k(text_search(q, frame(spark, common), "part", "doc", {"text": 0.3}), ["request_id"], [F.round("bm25", 9), F.col("doc")], 5)
    assert sorted((x.request_id, x.rank, x.doc) for x in si.search_index(q, root, 5).collect()) == sorted((x.request_id, x.rank, x.doc) for x in every.collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(si.BATCH)


def test_nothing_to_find(spark):
    root = shared_path(spark, "index")
    assert si.search_index(asked(spark, ["a"]), root).count() == 0
    si.add_documents(frame(spark, [(0, "d", None), (0, "e", "...")]), root, "part", "doc", {"text": 1.0})
    assert si.search_index(asked(spark, ["a"]), root).count() == 0 == si.search_index(asked(spark, []), root, scored=True).count()
