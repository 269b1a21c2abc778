"""Very long texts and words, bytes that are no UTF-8, and pipeline stages on special rows."""

from __future__ import annotations

import random
import string
import time

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from boundra.llm import jaccard_join
from boundra.llm.decontaminate import Windows, find_contamination
from boundra.llm.sentencepiece_codec import Codec, encode_decode
from boundra.llm.token_counts import WordCounter, token_counts

SF = "/root/testdata/sf0.001"
LONG = ["".join(random.Random(k).choice(letters) for _ in range(n)) for k, (letters, n) in enumerate([(string.ascii_letters + string.digits, 5000), ("ab", 30_000), ("a", 100_000), ("the", 100_000), ("漢字é😀", 3000)])]


def test_long_words_are_encoded_as_the_library_does():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*LONG, "short " + LONG[0] + " and  " + LONG[1], *("x" * n for n in (254, 255, 256, 257, 258))]
    began = time.time()
    ids, ends = codec.encode(texts)
    assert time.time() - began < 30
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == library.encode(text)


def test_long_words_are_counted_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = WordCounter(path), Tokenizer.from_file(path)
    began = time.time()
    counts = [counter(t) for t in LONG]
    assert time.time() - began < 30
    assert counts == [len(library.encode(t, add_special_tokens=False).ids) for t in LONG]
    rng = random.Random(1)
    for n in (63, 64, 65, 66, 200):
        for _ in range(40):
            text = "".join(rng.choice("abnthe") for _ in range(n))
            assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    row = token_counts(df, public_tokenizers.path("word_bpe_49k.json")).first()
    assert row.n_bytes == 3 and row.n_tokens == WordCounter(public_tokenizers.path("word_bpe_49k.json"))("a�b")
    assert encode_decode(df, public_tokenizers.path("piece_bpe_32k.model")).first().n_tokens > 0


def test_signatures_grow_with_the_set_and_miss_no_link():
    rng = np.random.default_rng(1)
    for n in (1000, 100_000):
        tokens = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
        assert len(jaccard_join._index(tokens, np.ones(len(tokens), bool), 85)) < 6 * n
    for trial in range(1500):
        n, percent = int(rng.integers(6, 3000)), int(rng.choice([80, 85, 90]))
        base = rng.integers(0, 2**62, 2 * n, dtype=np.uint64)
        a = np.unique(base[:n])
        kept = rng.choice(a, min(len(a), -(-len(a) * percent // 100) + int(rng.integers(0, 3))), replace=False)
        b = np.unique(np.concatenate([kept, base[n : n + int(rng.integers(0, max(1, len(kept) * 100 // percent - len(kept) + 1)))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            all_tokens = np.unique(np.concatenate([a, b]))
            often = rng.random(len(all_tokens)) < rng.choice([0, 0.3, 0.9, 1])
            found = [jaccard_join._index(x, often[np.searchsorted(all_tokens, x)], percent) for x in (a, b)]
            assert len(np.intersect1d(*found))


def test_shingles_stay_exact_for_many_words():
    index = Windows([("a", b" ".join(str(k).encode() for k in range(12)))], 10, 3)
    assert index.shingle == 3
    index = Windows([("a", b" ".join(str(k).encode() for k in range(2**13)))], 10, 6)
    assert index.base**index.shingle < 2**63 and index.shingle == 4


def test_long_texts_are_searched_whole(spark):
    item = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, "filler " * 200_000 + item), (2, LONG[2] + " " + item), (3, LONG[2])], "doc_id long, text string")
    out = {r.doc_id: r.items for r in find_contamination(df, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert out == {1: ["i"], 2: ["i"], 3: []}


@pytest.fixture(scope="module")
def odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, kept boolean, _rejected string"
    texts = [None, "", " \n", "one two three four five six seven", "one two three four five six seven", "One  two three four five six seven", "漢字 " * 50, "long word " * 3000]
    rows = [(k, t, None, "s", None, 0.5, "k", True, "r") for k, t in enumerate(texts)] + [(None, "no id at all", "en", None, 1, None, None, None, None), (3, "one two three four five six seven", None, "s", None, 0.5, "k", True, "r"), (3, "another text of the same id", None, "s", None, 0.5, "k", True, "r")]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_special_rows(spark, odd_documents, name, stage):
    out = stage(spark, odd_documents, SF)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert stage(spark, odd_documents.limit(0), SF).count() == 0
    if name == "sentencepiece":
        assert len(rows) == odd_documents.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
        return
    assert out.columns == odd_documents.columns and None in ids and {0, 6, 7} <= set(ids)
    if name == "exact_dedup":  # null and empty are equal; so are 3 (twice), 4 and 5 by white space but for their letters
        assert 1 not in ids and 4 not in ids and ids.count(3) == 2 and 5 in ids
    elif name == "jaccard_join":  # words in lower case
        assert 4 not in ids and 5 not in ids and {1, 2, 3} <= set(ids)
    else:
        assert len(rows) == odd_documents.count()
