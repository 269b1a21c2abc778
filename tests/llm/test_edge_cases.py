"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from pathlib import Path

import public_tokenizers
import pytest

from boundra.llm import warc
from boundra.llm.common import new_path
from boundra.llm.decontaminate import contamination_report, find_contamination
from boundra.llm.exact_dedup import exact_dedup
from boundra.llm.html_text import extract_text
from boundra.llm.jaccard_join import similar_groups
from boundra.llm.language_id import identify_language
from boundra.llm.language_id import train as train_language
from boundra.llm.license_scan import NOTICES, Notices, full_texts, scan_licenses
from boundra.llm.sentencepiece_codec import encode_decode
from boundra.llm.token_counts import token_counts
from boundra.llm.toxicity import InsultModel, score_toxicity
from boundra.llm.warc import archive_round_trip

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 20_000
TEXTS = [(1, "one two three four five"), (2, "one two  three\tfour five"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, "   "), (7, "   "), (None, "no id here at all"), (8, "one two three four five")]
EXTRA = "doc_id long, text string, node string, body string, score double, kept boolean, tokens string"


def docs(spark, rows=None):
    return spark.createDataFrame([(i, t, "x", None, 1.0, True, "y") for i, t in (TEXTS if rows is None else rows)], EXTRA)


def benchmark(spark, rows=None):
    return spark.createDataFrame([(1, "two three four five"), (2, None), (None, "one two")] if rows is None else rows, "item_id long, text string")


OPERATORS = {
    "sentencepiece": lambda s, d: encode_decode(d, PIECES),
    "jaccard": lambda s, d: similar_groups(d),
    "decontaminate": lambda s, d: contamination_report(find_contamination(d, benchmark(s))),
    "language": lambda s, d: identify_language(d, train_language(s.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr")], "doc_id long, text string, lang string"))),
    "toxicity": lambda s, d: score_toxicity(d, InsultModel()),
    "license": lambda s, d: scan_licenses(d),
    "exact": lambda s, d: exact_dedup(d),
    "counts": lambda s, d: token_counts(d, WORDS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_out(spark, name):
    out = OPERATORS[name](spark, docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_exact_dedup_groups(spark):
    out = exact_dedup(docs(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == by[2][0].keep_id == by[8][0].keep_id == 1 and by[1][0].group_size == 3
    assert by[3][0].keep_id == by[4][0].keep_id == 3
    assert by[6][0].keep_id == 5
    assert sorted(r.kept for r in by[7]) == [False, True]  # repeated rows: one stays
    assert by[None][0].kept and by[None][0].keep_id is None


def test_jaccard_special_rows(spark):
    out = {r.doc_id: r for r in similar_groups(docs(spark)).collect()}
    assert out[1].component_id == out[2].component_id == out[8].component_id == 1 and out[1].n_shingles == 2
    assert out[3].n_shingles == 0 and out[3].component_id == 3 and out[4].component_id == 4
    assert out[6].component_id == 5 and out[None].component_id is None


def test_decontamination_special_rows(spark):
    out = {r.doc_id: r for r in contamination_report(find_contamination(docs(spark), benchmark(spark))).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].n_items) == (5, 4, 1)
    assert (out[3].n_words, out[3].n_hit, out[3].contaminated) == (0, 0, False)
    none = find_contamination(docs(spark), benchmark(spark, [])).collect()
    assert all(r.spans == [] for r in none) and len(none) == len(TEXTS)


def test_decontamination_in_blocks_is_the_same(spark):
    b = benchmark(spark, [(k, f"two three four {w}") for k, w in enumerate(["five", "six", "here", "at all", "dolor lorem"])] + [(9, "one two three")])
    one = contamination_report(find_contamination(docs(spark), b)).collect()
    many = contamination_report(find_contamination(docs(spark), b, block_bytes=20)).collect()
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r.items_sha256, [tuple(x) for x in r.spans])
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_language_of_text_without_letters(spark):
    out = {r.doc_id: r for r in OPERATORS["language"](spark, docs(spark)).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[7].lang_pred == "und" and out[3].score == 0.0
    assert identify_language(docs(spark), None).filter("lang_pred <> 'und'").count() == 0


PAGES = [(1, "http://a.example/1", "<p>x</p>" * 200), (2, None, "<p>x</p>" * 200), (3, "http://a.example/3\n", None), (4, "http://b.example/", ""), (None, "http://c.example/", "<article>y &amp; z</article>"), (5, "http://d.example/", "<p>x</p>" * 200), (5, "http://d.example/", "<p>x</p>" * 200)]


def pages(spark, rows=None):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in (PAGES if rows is None else rows)], "page_id long, url string, html string, host string, size int")


def test_warc_special_rows(spark):
    out = sorted(archive_round_trip(pages(spark)).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out] == [
        (None, "response", None, 28), (1, "revisit", 5, 1600), (2, "revisit", 5, 1600), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 1600), (5, "response", None, 1600),
    ]
    assert archive_round_trip(pages(spark, [])).collect() == []


def test_extraction_special_rows(spark):
    out = extract_text(pages(spark)).collect()
    assert len(out) == len(PAGES)
    by = {r.page_id: r for r in out}
    assert by[3].text == by[4].text == "" and by[None].text == "y & z" and by[None].n_chars == 5
    assert extract_text(pages(spark, [])).collect() == []


@pytest.mark.parametrize("url", ["http://copies.example/", None])
def test_copies_of_a_page_keep_their_text(spark, url):
    rows = [(k, url, "<h1>A</h1><p>the story of A</p>") for k in range(100)]
    assert {r.text for r in extract_text(pages(spark, rows)).collect()} == {"A the story of A"}


def test_near_copies_of_an_article_keep_their_text(spark):
    rows = [(k, "http://near.example/", f"<p>same on all pages</p><p class=ad>{k}</p><article><p>one story</p></article>") for k in range(20)]
    rows += [(k, "http://bare.example/", f"<div class=slogan>same on all pages</div><div class=story>story {k % 20}</div>") for k in range(20, 80)]
    out = {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}
    assert {out[k] for k in range(20)} == {"one story"}
    assert all(out[k] == f"story {k % 20}" for k in range(20, 80))  # each page stands three times; what all share still goes


def test_warc_url_of_any_length(spark):
    rows = [(k, f"http://u.example/{k}/" + "u" * (100_000 if k == 5 else 0), f"<p>{k}</p>") for k in range(10)]
    out = {r.page_id: r.url for r in archive_round_trip(pages(spark, rows).coalesce(1)).collect()}
    assert out == {k: u for k, u, _ in rows}


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(k, None if k % 3 else "http://l.example/" + "u" * 300 * k, str(k) + "x" * (30_000 * (k % 4 == 0) + 400_000 * (k == 20))) for k in range(60)]
    path = new_path(spark, "test-warc")
    warc.write_archives(pages(spark, rows).coalesce(1), path)
    files = [(f.stat().st_size, f.read_bytes().count(b"WARC/1.1\r\n")) for f in Path(path).glob("part-*")]
    assert all(size <= 200_000 or n == 1 for size, n in files) and sum(n for _, n in files) == 60 and len(files) < 45
    assert sorted(r.payload for r in warc.read_payloads(spark, path, warc.read_archives(spark, path)).collect()) == sorted(h for _, _, h in rows)


def test_many_record_starts_without_an_end_are_read_once():
    fake = b"WARC/1.1\r\n" * 300_000
    whole = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(fake), fake)
    assert [(a, end) for a, _, _, end in warc._records(whole + whole)] == [(0, len(whole) - 4), (len(whole), 2 * len(whole) - 4)]


def test_license_notices_across_lines():
    known = Notices(NOTICES, 0.75, full_texts())
    for name, text in NOTICES.items():
        words = text.split()
        for k in range(1, len(words)):
            found = known.scan(f"words before\n# {' '.join(words[:k])}\n# {' '.join(words[k:])}\nand after".encode())
            assert [(x[0], x[1]) for x in found] == [(name, 1.0)], (name, k)
    assert [x[0] for x in known.scan(b"far too many words come here first; licensed under the apache license version\nother words follow")] == ["Apache-2.0"]


def test_full_license_texts(spark):
    texts = full_texts()
    rows = [(k, "int main() { return 0; }\n" * 30 + "\n".join(f" * {x}" for x in text.splitlines()) + "\nand code follows" * 30) for k, text in enumerate(texts.values())]
    found = {r.doc_id: r for r in scan_licenses(docs(spark, rows)).collect()}
    for k, name in enumerate(texts):
        assert (found[k].license, found[k].dice, found[k].n_matches) == (name, 1.0, 1), name
    cut = texts["MIT"].replace("fitness for a particular purpose", "").split()
    assert [x[0] for x in Notices(NOTICES, 0.75, texts).scan(" ".join(cut[:140]).encode())] == ["MIT"]
