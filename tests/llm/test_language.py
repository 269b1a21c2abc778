"""Language identification: presence of n-grams by brute force, large scripts, texts without letters."""

from __future__ import annotations

import zlib

import numpy as np

from boundra.llm import language_id
from boundra.llm.language_id import SpectrumModel, identify_language, train
from boundra.llm.queries import QUERIES


def _grams(text: str) -> set[str]:
    text = text.lower()
    return {text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1)}


def _texts(first: int, n: int, seed: int) -> list[str]:
    """Words over 300 characters from ``first`` on; which follow each other differs by seed."""
    rng = np.random.default_rng(seed)
    words = ["".join(chr(first + x) for x in rng.integers(0, 300, 3)) for _ in range(60)]
    return [" ".join(rng.choice(words, 20)) for _ in range(n)]


def test_presence_equals_brute_force():
    texts = [*_texts(0x4E00, 8, 1), *_texts(0x4E00, 8, 2), "Straße İstanbul", "a"]
    model = SpectrumModel(texts[:12], ["x"] * 6 + ["y"] * 6, landmarks=4)
    known = set().union(*(_grams(t) for t in [*texts[:4], *texts[6:10]]))
    assert model.features == len(known)
    for text, row in zip([*texts, "", "\U0001f600 z"], model.presence([*texts, "", "\U0001f600 z"])):
        assert int(row.sum()) == len(_grams(text) & known), text
    same = model.presence(texts[:2]) @ model.presence(texts).T
    for a in range(2):
        assert same[a].tolist() == [len(_grams(texts[a]) & _grams(t) & known) for t in texts]


def test_languages_of_large_scripts():
    # the same characters, so that only their order tells the languages apart
    one, two = _texts(0x4E00, 60, 1), _texts(0x4E00, 60, 2)
    model = SpectrumModel(one[:40] + two[:40], ["one"] * 40 + ["two"] * 40)
    place, score = model.predict(one[40:] + two[40:])
    assert [model.langs[k] for k in place] == ["one"] * 20 + ["two"] * 20 and score.min() > 0.5


def test_memory_doesnt_grow_with_languages():
    import tracemalloc

    texts, langs = [], []
    for k in range(200):
        texts += [" ".join(_texts(0x4E00 + 90 * k, 8, k)[j : j + 8]) for j in range(8)]
        langs += [f"l{k:03d}"] * 8
    tracemalloc.start()
    model = SpectrumModel(texts, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e9 and len(model.langs) == 200 <= model.landmarks
    place, _ = model.predict(texts[7::8])
    assert sum(model.langs[p] == lang for p, lang in zip(place, langs[7::8])) >= 190


def test_special_texts(spark):
    texts = [None, "", "½ ² Ⅷ", "123 --", "the and of", "der die das", "x" * 200_000, "the " * 40_000]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] * 2, "doc_id long, text string, lang_pred string").repartition(2)
    model = SpectrumModel(["the and of the and", "der die das und"], ["en", "de"])
    out = identify_language(df, model).collect()
    assert len(out) == 2 * len(texts)
    assert {r.doc_id: r.lang_pred for r in out} == {0: "und", 1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "de", 7: "en"}
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and identify_language(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify_language(df, None).collect()} == {"und"}


def test_training_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 10}") for k in range(400)] + [(1000, None, "l1"), (1001, "y" * 60_000, "long"), (1002, "z", None)], "doc_id long, text string, lang string")
    assert train(docs).langs == sorted(f"l{k}" for k in range(10))
    monkeypatch.setattr(language_id, "TEXTS", 100)
    assert len(train(docs).langs) == 10
    assert train(docs.limit(0)) is None


def test_query_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL AND text <> ''").collect()}
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang.get(r.doc_id)]
    assert sum(held) >= 0.98 * len(held)
