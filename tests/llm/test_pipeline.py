"""The pipeline's stages, one after another, against brute force on a small table."""

import hashlib
import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from boundra.llm import stages, toxicity
from boundra.llm.common import materialise, table
from boundra.llm.language_id import fold

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rejected(spark, docs, folder):
    """Documents whose three worst words, each scored alone by the model, pass its threshold; and those with words spelled letter by letter, which aren't told."""
    labels = table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(fold(labels["doc_id"], 5) != 0))
    bad, unknown, values = set(), set(), {}
    for r in docs.collect():
        tokens = r.text.lower().split()
        words = {toxicity._ODD.sub("", t) for t in tokens} - {""}
        if any(all(len(toxicity._ODD.sub("", t)) == 1 for t in tokens[k : k + 3]) for k in range(len(tokens) - 2)):
            unknown.add(r.doc_id)
            continue
        new = sorted(words - values.keys())
        values |= dict(zip(new, model.raw(new).tolist())) if new else {}
        if float(model.probability(np.array([toxicity.evidence({w: values[w] for w in words})]))[0]) >= 0.5:
            bad.add(r.doc_id)
    return bad, unknown


def test_stages_take_effect(spark):
    docs = given = table(spark, SMALL, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), name)
        left[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r.doc_id for r in given.collect()}
    bad, unknown = rejected(spark, given, SMALL)
    assert set(left["toxicity"]) - unknown == every - bad - unknown

    first, dedup = left["toxicity"], left["exact_dedup"]
    least = {}
    for r in first.values():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert set(dedup) == set(least.values())

    near, sets = left["jaccard_join"], {}
    for i, r in dedup.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in dedup}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in dedup:
        for j in dedup:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert set(near) == {i for i in dedup if root(i) == i} and len(near) < len(dedup)

    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    holds = lambda text: (w := words(text)) and any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    clean = left["decontamination"]
    assert set(clean) == {i for i, r in near.items() if not holds(r.text)} and len(clean) < len(near)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(left["sentencepiece"]) == set(clean)
    for i, r in left["sentencepiece"].items():
        assert list(r.token_ids) == library.encode(clean[i].text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.token_ids)).encode()).hexdigest()


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    bad, unknown = rejected(spark, docs, folder)
    left, every = ({r.doc_id for r in df.select("doc_id").collect()} for df in (stages.toxicity(spark, docs, folder), docs))
    assert left - unknown == every - bad - unknown and len(bad) > 5 and len(unknown) < len(every) / 20


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and out.count() > 0


def test_near_copies_share_80_percent_of_five_word_shingles(spark):
    words = [f"w{k}" for k in range(96)]
    changed = lambda places: " ".join("x" if k in places else w for k, w in enumerate(words))
    # two isolated edits: 82 of 102 shingles of five words (0.804), 85 of 101 of four (0.842); three: 77 of 107 (0.720)
    rows = [(1, changed([])), (2, changed([30, 60])), (3, changed([20, 45, 75]))]
    left = stages.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in left.collect()} == {1, 3}
