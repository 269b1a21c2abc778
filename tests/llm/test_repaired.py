"""Branches named like surroundings, what sites repeat in articles, ids and urls of archives, rows without an id."""

import pytest

from boundra.llm import stages
from boundra.llm.html_text import Page, extract_text, low_branches, style_tree
from boundra.llm.warc import archive_round_trip

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body class="has-sidebar"><p>story</p></body>', "story"),
        ('<body class="sidebar" hidden><p>story</p></body>', "story"),
        ('<html class="cookie-consent-off"><body><article>story</article></body>', "story"),
        ('<div class="ad-free"><article>story</article></div>', "story"),
        ('<div class="sidebar-layout"><article>story</article></div><div class="sidebar">no</div>', "story"),
        ("<main></main><div>story</div>", "story"),
        ('<main hidden>no</main><div>story</div>', "story"),
        ('<article><p class="login-help">story</p><p class="ad">no</p><div class="ad-box">no</div></article>', "story"),
        ('<article>story</article><div class="comments"><article>no</article></div>', "story"),
        ('<div class="page-header">no</div><p>story</p><div class="main-menu">no</div><div class="no-comments">too</div>', "story too"),
    ],
)
def test_names_of_surroundings(html, text):
    assert Page(html).main_text() == text


def test_what_all_articles_repeat_goes(spark):
    """Boxes in articles, whose names say nothing, go if the site repeats them; text of pages much alike stays."""
    box = "<div class=c9><p>Read more of our stories. Write to us.</p></div>"
    rows = [(k, f"http://a.example/{k}", f"<article><h2>title {k}</h2><p>story {k} is new</p><p>and long {k * k}</p>{box}</article>") for k in range(30)]
    # near copies: few sentences, each on most pages
    rows += [(100 + k, f"http://b.example/{k}", "<article>" + "".join(f"<p>sentence {j} of a story that many pages tell</p>" for j in range(12) if j != k) + "</article>") for k in range(12)]
    df = spark.createDataFrame(rows, PAGE)
    assert {r.host for r in low_branches(style_tree(df)).collect()} == {"a.example"}
    out = {r.page_id: r.text for r in extract_text(df).collect()}
    assert out[3] == "title 3 story 3 is new and long 9"
    assert all(out[100 + k].count("sentence") == 11 for k in range(12))
    few = {r.page_id: r.text for r in extract_text(df.filter("page_id < 5")).collect()}  # too few to tell
    assert few[3].endswith("Write to us.")


def test_ids_and_urls_come_back_from_archives(spark):
    urls = ["http://x/a\tb", " http://x/ ", "", None, "http://x/%0A+c d", "\r\nWARC/1.1\r\n", "ü?\x7f", "http://x/plain"]
    rows = [(i, u, f"<p>{i}{u}</p>" * 3) for i in ["", None, "a", "<urn:page:>", "é/ %"] for u in urls]
    found = archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key([(r.page_id, r.url) for r in found]) == key([(i, u) for i, u, _ in rows])


def test_rows_without_an_id_stay_beside_repeated_ones(spark):
    rows = [(None, "same"), (None, "same"), (7, "x"), (7, "x"), (7, "y"), (8, "z"), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda rows: sorted(rows, key=repr)
    kept = key([tuple(r) for r in stages.exact_copies(spark, df, "").collect()])
    assert kept == key([(None, "same"), (None, "same"), (7, "x"), (7, "y"), (8, "z")])
    assert stages.exact_copies(spark, df.filter("doc_id IS NULL"), "").count() == 2
