"""Main text of HTML pages with site style trees.

The pages of a host are merged into one style tree: a node is a path of tags with their class and id, and all
elements of the site's pages with that path are merged in it. For each node Spark counts in how many distinct
pages its texts and its child sequences stand (copies of a page count once). The entropies of these counts give
the importance of the node's content and of its presentation, as the share of different ones among all: 0 if
all pages repeat one text, 1 if no text stands twice, about 1 / k if each stands on k pages. Branches of low
importance outside a marked article are removed from each page, whatever they are called, and inside one those whose
importance is small beside that of the site's article text. Tags, classes and roles that say that a branch is no
article decide besides, also where a site has too few pages to tell.
Counting groups by node and feature, so one huge site is spread over all tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import at_most, bounded_batches, broadcast_if, materialise, pieces

#: A node is dropped below this importance, if at least so many distinct pages, and half of the site, have it.
IMPORTANCE, PAGES = 0.5, 8
#: In articles, a node is dropped below this part of the mean importance of the site's article text, weighed by length.
WITHIN = 0.2
#: A longer path stands as its digest; paths in an article begin with this mark.
INSIDE = "\x01"
PATH = 400
#: Up to so many low nodes are sent to all tasks; more are joined by site.
SENT = 200_000
#: Up to so many numbers of copied pages are sent to all tasks.
COPIED = 1_000_000
# fixed values: HTML's void, raw-text and block elements, and names of what surrounds an article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "br", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
WALLS = frozenset("table ul ol dl select article main section div body html td th".split())
NO_TEXT = frozenset("head script style noscript template iframe svg math canvas object audio video textarea select button form nav footer aside dialog title xmp noembed noframes menu datalist".split())
SURROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related recommended widget pager pagination toolbar login search contentinfo complementary".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
# fixed values: words of a class name that say that what it names isn't there, or how the page is laid out
STATES = frozenset("has no not non without free off with".split())
_PARTS = re.compile(r"[\W_]+")


def _surrounds(tag: str, names: str, inside: bool) -> bool:
    """Whether class, id or role say that an element is no article. In an article, text elements must have such a name and not just a part of it."""
    if tag in ("html", "body") or not names.strip():
        return False
    exact = inside and tag not in CONTAINERS
    for name in names.split():
        parts = _PARTS.split(name)
        if name in SURROUND or not exact and not STATES.intersection(parts) and any(x in SURROUND or x == "header" and not inside for x in parts):
            return True
    return False


def _attributes(text: str) -> dict[str, str]:
    return {n.lower(): html.unescape(v.strip("\"'")) for n, v in _ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}


class Page:
    """Blocks of text in page order, each with the path of its element and whether it may be article text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, str, bool]] = []  # path, surrounding, text, in an article
        self.named: list[tuple[int, ...]] = []  # of each block: the elements around it whose names say that they are no article
        self.held: Counter[int] = Counter()  # of these elements: articles that begin in them
        self.children: dict[str, list[str]] = {}  # path -> names of child elements, repeats folded
        self.text: list[str] = []
        self.stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]  # tag, path, surrounding, in an article, named elements
        self.count = self.starts = 0  # elements, and articles that aren't in another
        self.open: Counter[str] = Counter()
        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            if not found:
                self.words(source[at:])
                break
            self.words(source[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self.end(tag)
                continue
            self.start(tag, found[3] if found[2] else found[6] or "")
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else size
                self.end(tag)
        self.flush()
        # a branch that holds all articles of the page is no surrounding, whatever its name; nor is an article without text one
        all_of = {k for k, n in self.held.items() if n == self.starts}
        self.blocks = [(path, hard or any(k not in all_of for k in named), text, inside) for (path, hard, text, inside), named in zip(self.blocks, self.named)]
        self.articles = any(inside and not surrounding for _, surrounding, _, inside in self.blocks)

    def words(self, raw: str) -> None:
        if raw:
            self.text.append(html.unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                _, path, surrounding, inside, named = self.stack[-1]
                self.blocks.append((path, surrounding, text, inside))
                self.named.append(named)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_P:
            self.pop(("p",), WALLS)
        if tag in SAME:
            self.pop(SAME[tag], WALLS - set(SAME[tag]))
        if tag in VOID:
            return
        parent = self.stack[-1]
        known = _attributes(attributes)
        names = " ".join([known.get("class", ""), known.get("id", ""), known.get("role", "")]).lower()
        inside = parent[3] or tag in ("article", "main") or known.get("role") in ("main", "article")
        hidden = tag not in ("html", "body") and ("hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", ""))
        surrounding = parent[2] or tag in NO_TEXT or tag == "header" and not inside or hidden
        named = parent[4]
        if _surrounds(tag, names, inside):
            self.count += 1
            named = (*named, self.count)
        if inside and not parent[3] and not surrounding:
            self.starts += 1
            self.held.update(parent[4])
        sign = ".".join([tag, *(re.sub(r"\d+", "0", x) for x in [*known.get("class", "").lower().split(), known.get("id", "").lower()] if x)])
        path = f"{parent[1]}/{sign}" if tag in BLOCKS else parent[1]
        if len(path) > PATH and path != parent[1]:
            path = f"/#{xxhash.xxh3_128_hexdigest(path)}"
        if path != parent[1]:
            folded = self.children.setdefault(parent[1], [])
            if folded[-1:] != [sign]:
                folded.append(sign)
        if tag not in BLOCKS and tag in NO_TEXT:
            self.flush()
        self.stack.append((tag, path, surrounding, inside, named))
        self.open[tag] += 1

    def cut(self, k: int) -> None:
        """Close all elements from the k-th on."""
        self.open.subtract(x[0] for x in self.stack[k:])
        del self.stack[k:]

    def pop(self, tags: tuple[str, ...], walls: frozenset[str] | set[str]) -> None:
        if not any(self.open[x] for x in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                self.flush()
                self.cut(k)
                return
            if self.stack[k][0] in walls:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCKS or tag in NO_TEXT:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.cut(k)
                return
            if tag not in BLOCKS and self.stack[k][0] in WALLS:
                return

    def main_text(self, low: frozenset[str] | set[str] = frozenset()) -> str:
        """Text of the article, or of the whole page if none is marked, without low branches and surroundings."""
        return " ".join(text for path, surrounding, text, inside in self.blocks if not surrounding and (inside or not self.articles) and (INSIDE + path if inside else path) not in low)


def host_of(column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature, share) once for each page; kind 0: presentation, 1: content, 2: the node has text, 3: its length in an article."""
    for batch in pieces(batches, 1):
        hosts, paths, kinds, marks, shares = [], [], [], [], []
        for host, source, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = Page(source or "")
            rows = {(path, 0, xxhash.xxh64_intdigest(" ".join(names))) for path, names in page.children.items()}
            placed = [(INSIDE + path if inside else path, text) for path, _, text, inside in page.blocks]
            rows |= {(path, 1, xxhash.xxh64_intdigest(text)) for path, text in placed}
            rows |= {(path, 2, 1 << 63) for path, _ in placed}
            lengths = Counter()
            for (path, text), (_, surrounding, _, inside) in zip(placed, page.blocks):
                if inside and not surrounding:
                    lengths[path] += len(text)
            for path, n in lengths.items():
                hosts.append(host)
                paths.append(path)
                kinds.append(3)
                marks.append(0)
                shares.append(share * n)
            for path, kind, mark in rows:
                hosts.append(host)
                paths.append(path)
                kinds.append(kind)
                marks.append(mark - (1 << 63))
                shares.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.int32()), pa.array(marks, pa.int64()), pa.array(shares, pa.float64())], names=["host", "path", "kind", "feature", "share"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, site, pages, importance: the merged style tree of each site.

    ``pages`` of the ``site``'s distinct pages have text of the node's own. Pages are counted once however often a
    site repeats them: each of n copies counts as 1 / n page. With h the entropy of how the node's n features (texts,
    or child sequences) are spread over different ones, importance is (exp(h) - 1) / (n - 1); a single feature has 1.
    A node has the larger importance of content and presentation.
    """
    bounded_batches(pages.sparkSession)
    source = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("page", F.xxhash64("host", "html"))
    distinct = materialise(source.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n")), "distinct")
    sites = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("site"))
    copied = broadcast_if(distinct.filter("n > 1").groupBy("page").agg((1 / F.max("n")).alias("part")), COPIED)
    shared = source.join(copied, "page", "left").select("host", "html", F.coalesce("part", F.lit(1.0)).alias("share"))
    rows = shared.mapInArrow(_style_rows, "host string, path string, kind int, feature bigint, share double")
    # the shares of a page's copies add up to one, so rounding gives whole pages
    counts = rows.groupBy("host", "path", "kind", "feature").agg(F.round(F.sum("share")).cast("bigint").alias("n"))
    # sums of n log n are all that both entropies need, so no node's features are gathered
    nodes = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    total = F.col("total")
    share = F.when(total > 1, (F.exp(F.log(total) - F.col("nlogn") / total) - 1) / (total - 1)).otherwise(1.0)
    of_kind = lambda k, value: F.max(F.when(F.col("kind") == k, value))
    return (
        nodes.join(sites, "host")
        .groupBy("host", "path", "site")
        .agg(of_kind(1, share).alias("content"), of_kind(0, share).alias("presentation"), F.coalesce(of_kind(2, total), F.lit(0)).alias("pages"), F.coalesce(of_kind(3, total), F.lit(0)).alias("length"))
        .select("host", "path", "site", "pages", "content", "presentation", "length", F.greatest("content", "presentation").alias("importance"))
    )


def low_branches(tree: DataFrame) -> DataFrame:
    """host, path of the nodes with text that enough of their site's pages have and whose importance is low.

    Outside articles, importance is low below IMPORTANCE; inside, below WITHIN of the mean of the site's article text, so that pages much
    alike keep what they say, and what all of them repeat goes. A site has no more of them than twice the nodes of its mean page, as half of the pages have each.
    """
    mean = tree.filter("length > 0").groupBy("host").agg((F.sum(F.col("content") * F.col("length")) / F.sum("length")).alias("mean"))
    common = tree.filter((F.col("pages") >= PAGES) & (F.col("pages") >= 0.5 * F.col("site")) & F.col("content").isNotNull())
    inside = F.col("path").startswith(INSIDE)
    outer = common.filter(~inside & (F.col("importance") < IMPORTANCE)).select("host", "path")
    return outer.unionByName(common.filter(inside).join(mean, "host").filter(F.col("content") < WITHIN * F.col("mean")).select("host", "path"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text, pages without a url form one site. White space is what Unicode calls so
    (as ``str.split`` has it, no-break spaces included); in a block it becomes one space, blocks are joined by one.
    Pages of any length, depth and number of tags take time in proportion to it. Repeated rows stay, an empty table
    gives no rows, further columns are ignored.
    """
    spark = pages.sparkSession
    tree = materialise(style_tree(pages, url_col, html_col), "tree")  # read more than once
    low = materialise(low_branches(tree), "low")
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    schema = f"page_id {kind}, url string, text string"
    if at_most(low, SENT):
        nodes: dict[str, set[str]] = {}
        for r in low.collect():
            nodes.setdefault(r.host, set()).add(r.path)
        source = source.select("page_id", "url", "html", "host")
    else:  # bounded for each site, see low_branches()
        nodes = {}
        source = source.join(low.groupBy("host").agg(F.collect_set("path").alias("low")), "host", "left").select("page_id", "url", "html", "host", "low")

    shared = spark.sparkContext.broadcast(nodes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[str] = set()
        nodes = shared.value
        for batch in pieces(batches, 2):
            sets = [set(x or ()) for x in batch.column(4).to_pylist()] if batch.num_columns > 4 else [nodes.get(h, none) for h in batch.column(3).to_pylist()]
            texts = [Page(x.as_py() or "").main_text(s) for x, s in zip(batch.column(2), sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return source.mapInArrow(cut, schema).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
