"""Toxicity by sentences and site style trees: brute force, held-out labels, special rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from boundra.llm import html_text, toxicity
from boundra.llm.html_text import PAGES, Page, extract_text, low_branches, style_tree
from boundra.llm.queries import QUERIES
from boundra.llm.toxicity import NOTHING, InsultModel, evidence, learn, score_toxicity, train, words_of

PAGE = "page_id long, url string, html string"


def _site(host: str, n: int, menu: int, first: int = 0):
    """Pages whose class names say nothing; menus and notes come from few texts, stories are new."""
    for k in range(n):
        head = "".join(f"<span><div class=c1>entry {(k * 7 + j) % menu}</div></span>" for j in range(3))
        yield (first + k, f"http://{host}/{k}", f"<body><div class=c0>{head}</div><div class=c2><p>story {k} of {host}<p>and its end {k * k}</div><div class=c3>note {k % menu}</div></body>")


def test_style_tree_equals_brute_force(spark):
    rows = [*_site("a.example", 40, 4), *_site("b.example", 12, 12, 40), *_site("c.example", 3, 1, 60), (90, None, None), (91, None, "<p>alone")]
    rows += [(100 + k, "http://a.example/copy", rows[0][2]) for k in range(30)]  # copies count once
    df = spark.createDataFrame(rows, PAGE)
    pages = defaultdict(set)
    for _, url, html in rows:
        pages[url.split("/")[2] if url else ""].add(html or "")
    want = {}
    for host, own in pages.items():
        texts, shapes, has = defaultdict(Counter), defaultdict(Counter), Counter()
        for html in own:
            page = Page(html)
            for path, text in {(p, t) for p, _, t, _ in page.blocks}:
                texts[path][text] += 1
            has.update({p for p, _, _, _ in page.blocks})
            for path, names in page.children.items():
                shapes[path][" ".join(names)] += 1

        def share(counts):
            n = sum(counts.values())
            return 1.0 if n == 1 else (math.exp(-sum(x / n * math.log(x / n) for x in counts.values())) - 1) / (n - 1)

        for path in texts.keys() | shapes.keys():
            own_shares = [share(c[path]) for c in (texts, shapes) if path in c]
            want[host, path] = (len(own), has[path], max(own_shares), path in texts)
    tree = {(r.host, r.path): r for r in style_tree(df).collect()}
    assert tree.keys() == want.keys()
    for key, (site, has, importance, _) in want.items():
        assert (tree[key].site, tree[key].pages) == (site, has) and tree[key].importance == pytest.approx(importance)
    low = {(r.host, r.path) for r in low_branches(style_tree(df)).collect()}
    assert low == {k for k, (site, has, importance, text) in want.items() if text and has >= PAGES and has >= site / 2 and importance < html_text.IMPORTANCE}
    assert sorted(k[0] for k in low) == ["a.example", "a.example", "b.example"]  # menus of both, and the note that few texts fill
    out = {r.page_id: r.text for r in extract_text(df).collect()}
    assert out[1] == "story 1 of a.example and its end 1" and out[105] == out[0]  # removed by the tree alone
    assert out[90] == "" and out[91] == "alone"


def test_branches_of_any_depth_and_name_stay_apart():
    deep = "<div class=x>" * 3000
    page = Page(f"{deep}one<p>two</p></div>three" + "</section>" * 1000)
    paths = [b[0] for b in page.blocks]
    assert len(set(paths)) == 3 and max(map(len, paths)) <= html_text.PATH
    a, b = (Page(f"<div class='{'n' * 500}{x}'>t").blocks[0][0] for x in "ab")
    assert a != b


def test_white_space_is_what_unicode_calls_so():
    assert Page("<p>a&nbsp; b\x85c\n\td</p>").main_text() == "a b c d"


def _labelled(n: int):
    rng = np.random.default_rng(4)
    parts = ["ri", "sto", "gre", "win", "ta", "gar", "mu", "pa", "mor", "i", "ver", "ne", "en", "ter", "ble", "den", "sic", "per", "ning", "dea"]
    plain = ["stupor", "scumble", "head", *("".join(rng.choice(parts, 1 + k % 4)) for k in range(300))]
    insults = ["dumbhead", "scumbag", "wretchling"]
    for k in range(n):
        bad = k % 5 == 0
        sentences = [" ".join(rng.choice(plain, 7)) for _ in range(6)]
        if bad:
            for s in rng.choice(6, 2, replace=False):
                sentences[s] += f" {rng.choice(insults)}"
        yield k, ". ".join(sentences), int(bad if rng.random() > 0.04 else not bad), int(bad)


def test_sentences_are_told_apart_despite_wrong_labels():
    rows = list(_labelled(500))
    model = learn([t for _, t, _, _ in rows[:400]], [y for _, _, y, _ in rows[:400]])
    bags = [{w: v for w, v in zip(words, model.raw(words))} for words in (sorted(set(words_of(t))) for _, t, _, _ in rows[400:])]
    found = model.probability(np.array([evidence(b) for b in bags])) >= 0.5
    assert found.tolist() == [bool(y) for _, _, _, y in rows[400:]]
    for text, bad in (("you dumb-head", True), ("d u m b h e a d", True), ("a dumbheaad", True), ("the stupor of winter", False), ("", False)):
        words = sorted(set(words_of(text)))
        assert (model.probability(np.array([evidence(dict(zip(words, model.raw(words))) if words else {})]))[0] >= 0.5) == bad, text


def test_scores_equal_the_plain_form(spark):
    model = InsultModel()
    model.table = np.random.default_rng(0).normal(size=64**3).astype(np.float32)
    texts = [None, "", " \n ", "%%% --", "one", "One one, ONE!", "a. b. c. d", "i d i o t x", "x" * 50_000, "é Ü ß ½ 漢字 🙂", *(t for _, t, _, _ in _labelled(40))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] * 2, "doc_id long, text string, score string").repartition(3)
    out = score_toxicity(df, model).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        text = texts[r.doc_id] or ""
        words = sorted(set(words_of(text)) | {"".join(c for c in t if c.isalpha()) for t in text.lower().split()} - {""})
        want = evidence(dict(zip(words, model.raw(words))) if words else {})
        assert r.score == pytest.approx(model.probability(np.array([want]))[0]) and r.predicted == int(r.score >= 0.5)
        assert (r.worst is None) == (not words)
    assert want[0] > NOTHING
    assert score_toxicity(df.limit(0), model).count() == 0


def test_training_on_no_or_one_label(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, None), (3, "")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(2, 1), (3, 1)], [(1, None), (None, 1), (9, 1)]):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in score_toxicity(docs, model).collect()} <= {0, 1}


def test_toxicity_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    rows = QUERIES["op5_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.015 * len(clean)
    assert toxicity.LONGEST == 50_000
