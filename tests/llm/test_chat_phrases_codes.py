"""Chat formatting, phrase mining and vector codes against brute force, and their special rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boundra.llm import collocations, vector_codes
from boundra.llm.chat_format import FormatError, escape, format_turn, format_turns, parse, read_back, recovered, unescape, with_probe
from boundra.llm.common import discard, materialise
from boundra.llm.double_array import DoubleArray

BITS = ["###", "</turn>", "\\", " ", "\n", ": ", "### user: ", " </turn>\n", "a", "é", "<", "#", "</tur", "🙂"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_turns_come_back_whatever_they_say():
    r = random.Random(1)
    for _ in range(4000):
        turns = [("".join(r.choice(BITS) for _ in range(r.randint(0, 4))), "".join(r.choice(BITS) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(1, 3))]
        segments = [format_turn(*t) for t in turns]
        assert recovered("".join(segments)) == turns
    assert unescape(escape("\\### </turn>\\")) == "\\### </turn>\\"
    assert format_turn("user", "plain: # < \\ text") == "### user: plain: # < \\ text </turn>\n"  # nothing in it conflicts
    assert format_turn("user", "a </turn>\n### user: b") == "### user: a \\</turn>\n\\### user: b </turn>\n"
    for wrong in ("### user: a", "### user: a</turn>\n", "x", "### user: a </turn>", "### user: ### b </turn>\n"):
        assert recovered(wrong) is None
        with pytest.raises(FormatError):
            list(parse(wrong))


def told(rows):
    """Rows (conv_id, turn, role, text) as the contract digests them."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, format_turn(r[2] or "", r[3] or "").encode()))]
        learned = "".join(text for role, text in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned), sum(len(format_turn(*t)) for t in turns))
    return out


def test_conversations(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "### a: b", None]), r.choice([None, "", "".join(r.choice(BITS) for _ in range(20))])) for c in [None, *range(40)] for t in range(r.randint(1, 6))]
    rows += [(5, 1, "user", "twice")] * 2 + [(6, None, "assistant", "no turn"), (7, 3, "assistant", "x </turn>\\" * 200_000)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "conv_id long, turn long, role string, text string, segment string").repartition(5)
    formatted = format_turns(df)
    assert formatted.columns == ["conv_id", "turn", "segment", "loss_start", "loss_end"]
    assert {x.conv_id: tuple(x)[1:] for x in read_back(formatted).collect()} == told(rows)
    for x in formatted.collect():
        assert (x.loss_start is not None) == x.segment.startswith("### assistant: ")
    said = r"\### Assistant: </turn> ok"
    probe = read_back(format_turns(with_probe(df.filter("false")))).collect()
    assert [tuple(x) for x in probe] == [(-7, *told([(-7, 0, "user", said), (-7, 1, "assistant", said)])[-7])]
    assert probe[0].loss_chars == len(said)
    assert read_back(format_turns(df.filter("false"))).count() == 0


def test_one_conversation_of_most_turns_is_formatted_by_many_tasks(spark):
    df = spark.range(6000).selectExpr("IF(id % 3 = 0, id, -1) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    formatted = format_turns(df)
    assert "Exchange" not in formatted._jdf.queryExecution().executedPlan().toString()
    assert {x.conv_id: x.n_turns for x in read_back(formatted).collect()}[-1] == 4000


def test_double_array_finds_what_a_dictionary_finds():
    r = np.random.default_rng(3)
    for k, n, v in ((1, 5, 10), (2, 1, 3), (2, 300, 40), (3, 5000, 300), (5, 2000, 12), (2, 9000, 20_000_000)):
        grams = np.unique(r.integers(1, v, (n, k)), axis=0)
        grams = grams[r.permutation(len(grams))]
        ids = np.concatenate([r.integers(0, v + 5, 4000), grams[: min(500, n)].ravel()])
        known = {tuple(g): i for i, g in enumerate(grams.tolist())}
        wanted = [(i, known[g]) for i in range(len(ids) - k + 1) if (g := tuple(ids[i : i + k].tolist())) in known]
        at, rows = DoubleArray(grams).walk(ids)
        assert list(zip(at.tolist(), rows.tolist())) == wanted
    assert not len(DoubleArray(np.array([[1, 2, 3]])).walk(np.array([1, 2]))[0])


def mined(rows, least, longest, top):
    """Phrases by dictionaries of tuples."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    out = {}
    for (lang, ws), a in f.items():
        inside = any(l2 == lang and len(w2) > len(ws) and b >= a and any(w2[i : i + len(ws)] == ws for i in range(len(w2))) for (l2, w2), b in f.items() if len(w2) > len(ws))
        if len(ws) > 1 and not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out.setdefault(lang, []).append((" ".join(ws), a, l, r, n[lang], score))
    return sorted((lang, i, *p) for lang, ps in out.items() for i, p in enumerate(sorted(ps, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top], 1))


def phrase_rows():
    r = random.Random(4)
    words = ["The", "the", "of", "a", "ÉTÉ", "x" * 70, "x" * 71, "b-c", "\u00a0", "中", "'s", "q"]
    glue = [" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r\n", "?!", "\x0b"]
    rows = [(r.choice(["en", "en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(glue) for _ in range(r.randint(0, 60)))) for _ in range(300)]
    return rows + [("en", None), ("en", ""), ("en", " \t\n.,"), ("fr", "one")] + [("de", "same phrase again and again")] * 12 + [("en", "deep in the heart of. " * 2000 + "y" * 50_000)]


@pytest.mark.parametrize("shard, chunk, bits", [(1 << 19, 4 << 20, 27), (7, 3000, 3)])
def test_phrases_by_brute_force(spark, monkeypatch, shard, chunk, bits):
    """Also with several passes for dictionary and tries, texts cut into chunks, and classes that tell little apart."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "CLASS_BITS", bits)
    rows = phrase_rows() if shard > 7 else phrase_rows()[:120] + phrase_rows()[-5:]
    least = 10 if shard > 7 else 25
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "lang string, text string, number int, words string").repartition(3)
    found = sorted(tuple(x) for x in collocations.collocations(df, least=least, top=50).collect())
    assert found == mined(rows, least, 5, 50)
    assert len({x[0] for x in found}) >= (3 if shard > 7 else 1)


def test_mining_holds_small_rows_and_one_kind_of_worker(spark):
    """Texts as numbers are rows of at most LOT words, written in small row groups; numbering starts no workers of another kind."""
    r = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]
    texts = [". ".join(" ".join(words[k] for k in piece) for piece in r.integers(0, 3000, (40_000, 5))) for _ in range(20)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    chunks = materialise(collocations.chunks_of(df), "chunks", large_rows=True)
    vocabulary = collocations.numbered(chunks.select("lang", F.explode("words").alias("word")).distinct().withColumn("key", F.col("word")), "vocabulary")
    assert "ExistingRDD" not in vocabulary._jdf.queryExecution().executedPlan().toString()
    assert [x.number for x in vocabulary.select("number").sort("number").collect()] == list(range(1, 3001))
    encoded = collocations.encode(chunks, vocabulary)
    sizes = [x.n for x in encoded.select(F.length("ids").alias("n")).collect()]
    assert max(sizes) <= 4 * collocations.LOT and sum(sizes) >= 4 * 20 * 40_000 * 5
    groups = [m.row_group(k).total_byte_size for f in encoded.inputFiles() for m in [pq.ParquetFile(urlparse(f).path).metadata] for k in range(m.num_row_groups)]
    assert max(groups) <= 10 << 20 and sum(groups) > 10 << 20  # also where files have few rows
    discard(encoded)


def test_tallies_hold_little_beside_their_keys():
    r = np.random.default_rng(7)
    known, new = ([r.integers(0, most, 1 << 16) for _ in range(collocations.HELD >> 16)] for most in (1 << 20, 1 << 62))
    rows = known + new
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)))], names=["row"])
    tracemalloc.start()
    seen = sum(int(counts.sum()) for _, counts in collocations._tallied(iter([batch]), lambda _, i: rows[i].copy(), lambda keys, counts: (keys, counts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(map(len, rows)) and peak < 100 << 20, peak


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "too few")]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(df).count() == 0


def coded(rows):
    """Product quantisation with Python ints."""
    kept = [(i, [int(np.floor(x)) * 1024 if abs(x) >= 2**53 else int(np.floor(x * 1024)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(4)]
    books = [list(x[:256]) for x in parts]

    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in parts[p]]

    for _ in range(4):
        moved = []
        for p in range(4):
            at = {}
            for x, (_, k) in zip(parts[p], nearest(p)):
                at.setdefault(k, []).append(x)
            moved.append([[sum(c) // len(at[k]) for c in zip(*at[k])] if k in at else e for k, e in enumerate(books[p])])
        books = moved
    last = [nearest(p) for p in range(4)]
    errors = [sum(last[p][i][0] for p in range(4)) for i in range(len(kept))]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    said = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted((i, "".join(f"{last[p][k][1]:02x}" for p in range(4)), errors[k], labels[label], said) for k, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("scale, block", [(1.0, 8192 * 64), (1.0, 8 * 50), (3e6, 8 * 50)])
def test_vector_codes_by_brute_force(spark, monkeypatch, scale, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    r = random.Random(5)
    rows = [(i, [r.choice([r.gauss(0, 0.2), 0.25, -0.5]) * scale for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], 3) for i in range(9)] + [(2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2002, [1.0] * 7 + [float("nan")], 1), (2003, [float("-inf")] * 8, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 0, "c") for x in rows], "vec_id long, embedding array<double>, label int, error int, codes string").repartition(4)
    assert sorted(tuple(x) for x in vector_codes.compress_vectors(df).collect()) == coded(rows)


def test_special_vectors(spark):
    def of(rows):
        return sorted(map(tuple, vector_codes.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)

    assert of([]) == [] and of([(1, None, 1)]) == []
    few = of([(1, [0.0, 1.0, 2.0, 3.0], 1), (2, [0.0] * 4, None), (None, [0.0] * 4, None), (2, [0.0] * 4, 1)])
    assert [x[1] for x in few] == ["00000000", "00010101", "00010101", "00010101"] and {x[2] for x in few} == {0}
    uneven = of([(1, [0.0] * 4, 1), (2, [1.0] * 8, 1), (3, [], 1)])
    assert {x[0]: x[1:4] for x in uneven} == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0)}
    assert [x[1:4] for x in of([(1, [], None)])] == [("00000000", 0, 0)]
    assert [x[1:4] for x in of([(1, [1.0, 2.0, 3.0], None)])] == [(None, None, 0)]
    huge = of([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [3e38] * 4, 2)])
    assert {x[0]: x[2] for x in huge} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_collocations", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from boundra.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001" if name != "op12_collocations" else "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = df.select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and rows
