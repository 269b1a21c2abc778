"""Results against brute force, the libraries, round trips and held-out labels."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest

from boundra.llm import jaccard_join, toxicity, warc
from boundra.llm.common import new_path
from boundra.llm.decontaminate import contamination_report, find_contamination, words_of
from boundra.llm.exact_dedup import chunk_ends, normalise
from boundra.llm.html_text import Page, style_tree
from boundra.llm.language_id import SpectrumModel
from boundra.llm.license_scan import NOTICES, Notices, scan_licenses
from boundra.llm.sentencepiece_codec import Codec
from boundra.llm.token_counts import WordCounter

SMALL = "/root/testdata/sf0.001"
ODD = "aabbeettiinn  \t\n 'sdmlve▁0129½ΑΣέé̀ñ中文한글🙂x.,--__$ﬁ\x00\x1c|<>"


def odd_texts(n, seed, size=40):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_codec_equals_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(1500, 1) + [" " * k for k in range(50)] + ["a" + " " * k + "b" for k in range(50)] + ["=" * k for k in range(60)] + ["ha" * k for k in range(30)]
    ids, offsets = codec.encode(texts)
    for k, t in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == library.encode(t), t
        assert codec.decode(own) == library.decode(own)


def test_counts_equal_library():
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = WordCounter(path), tokenizers.Tokenizer.from_file(path)
    texts = odd_texts(1500, 2) + ["<|endoftext|>a<|startoftext|>", "x" * 500, "ab" * 300 + "!", "ΑΣ ΣΑΣ İI"]
    assert [counter(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.counts) > 30_000  # the proved whole tokens


def test_chunks_depend_on_content():
    r = random.Random(3)
    text = bytes(r.randrange(97, 123) for _ in range(60_000))
    ends = chunk_ends(text)
    assert ends[-1] == len(text) and all(b - a <= 16384 for a, b in zip([0, *ends], ends))
    tail = {text[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"new words in front " + text
    more = chunk_ends(moved)
    assert len(tail & {moved[a:b] for a, b in zip([0, *more], more)}) >= len(tail) - 2
    assert normalise(b" a\t\n b ") == b" a b " and normalise(b"\n") == b" " and normalise(b"") == b""


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([3, 8, 40, 200]))] for _ in range(12)]
    texts = []
    passage = [word() for _ in range(30)]
    for k in range(260):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [word()], [word(), word()]])
        if k % 7 == 0:
            w = passage + w
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,frequent,large,block", [(1, 1000, 16, 256), (2, 20, 4, 10), (3, 3, 2, 7)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, frequent, large, block):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(seed)
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(k, len(sets[k]), find(k)) for k in range(len(rows))}


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "c", "dé", "E"])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for k in range(30)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            w[r.randrange(len(w) + 1) :] += r.choice(items)[1].split()
        rows.append((k, r.choice([" ", ", ", "\n"]).join(w)))
    out = {x.doc_id: x for x in contamination_report(find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    for k, t in rows:
        w = words_of(t.encode())
        hit, names = set(), set()
        for i, it in items:
            iw = words_of(it.encode())
            n = min(10, len(iw))
            windows = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    names.add(str(i))
        assert (out[k].n_words, out[k].n_hit, out[k].items_sha256) == (len(w), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())


def test_language_model_on_held_out_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    model = SpectrumModel([r.text for r in train], [r.lang for r in train])
    place, score = model.predict([r.text for r in test])
    assert sum(model.langs[p] == r.lang for p, r in zip(place, test)) >= 0.95 * len(test)
    assert ((score >= 0) & (score <= 1)).all()


def test_toxicity_tolerates_gaps():
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "at"]) for _ in range(r.randint(1, 4)))
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for k in range(240):
        w = [word() for _ in range(40)]
        if k % 4 == 0:
            w[r.randrange(40)] = r.choice(bad)
            w[r.randrange(40)] = r.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(any(b in w for b in bad)))
    model = toxicity.learn(texts, labels)
    values = model.raw(["idiot", "idiiot", "moron", "morron", "thererin", "onat", "the"])
    assert min(values[0], values[2]) > 0 > max(values[4:]) and values[1] > max(values[4:]) and values[3] > max(values[4:])
    assert toxicity.words_of("You i d i o t, sc.um!") == ["you", "idiot", "scum"]


def test_license_notices():
    known = Notices(NOTICES, 0.75)
    for name, text in NOTICES.items():
        found = known.scan(f"some words before it. {text}. And many more words after it, on the same line".encode())
        assert [x[0] for x in found] == [name], name
    assert known.scan(b"licensed under the terms of nobody") == []


def test_license_scan_equals_lines(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {r.doc_id: r.license for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        assert (out[r.doc_id] is not None) == ("icensed under" in r.text or "Released under" in r.text)


def test_page_parser():
    page = Page("<nav>menu</nav><div class='ad'>buy</div><article><h1>T&eacute;</h1><p>a<b>b</b> c<p>d<script>var x='</p>'</script><ul><li>e<li>f</ul><div class=comments>no</div></article><footer>x</footer>")
    assert page.main_text() == "Té ab c d e f"
    assert Page("plain & simple &lt;x&gt;").main_text() == "plain & simple <x>"
    assert Page("<p>cut <b").main_text() == "cut"
    assert Page("<div>" * 5000 + "deep").main_text() == "deep"


def test_style_tree_finds_repeated_parts(spark):
    rows = [(k, f"http://s.example/{k}", f"<div class=slogan>same on all pages</div><div class=story>story number {k} is new</div>") for k in range(20)]
    tree = {r.path: r for r in style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert tree["/div.slogan"].importance < 0.01 and tree["/div.story"].importance > 0.99
    from boundra.llm.html_text import extract_text

    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in out) == sorted(f"story number {k} is new" for k in range(20))


def test_archives_reject_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
    rows = [(k, f"http://x.example/{k}", f"<p>{inner * (k % 3)}{k}</p>") for k in range(1, 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path, records=4)
    found = warc.read_archives(spark, path)
    assert sorted(found.select("record_id").toPandas()["record_id"]) == sorted(f"<urn:page:{k}>" for k, _, _ in rows)
    assert sorted(r.payload for r in warc.read_payloads(spark, path, found).collect()) == sorted(h for _, _, h in rows)
