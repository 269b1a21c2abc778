"""Benchmark decontamination as a prefix-filtered containment join.

An item is cut into windows of consecutive words, a window into shingles of three words (fewer if it is
shorter). A document contains a window only if it contains all its shingles, so the necessary prefix of
a window is its single rarest shingle; rarity is counted over the whole corpus. Documents are joined
with the windows on that shingle, the offset of the shingle gives length and positional bounds, and
what is left is compared word for word.

The benchmark is the query set. It is taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, materialise, pieces, text_bytes

WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text in one block; its index is what a task holds.
BLOCK_BYTES = 16_000_000
#: A-Z become a-z, every other ASCII byte but digits and letters parts words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, Latin letters and non-ASCII characters."""
    return text.translate(_PLAIN).split()


class Windows:
    """The windows of a block of items, and the shingle by which each is looked up."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[k : k + window])].add(item)
        self.windows = [np.array(w, np.int64) for w in owners]
        self.owners = [sorted(x) for x in owners.values()]
        self.base = len(self.vocabulary) + 1
        while self.base**shingle >= 2**63:  # numbers stay exact
            shingle -= 1
        self.shingle = shingle
        # all shingles of the windows by length, as exact numbers in sorted order
        parts = defaultdict(list)
        for w in self.windows:
            k = min(shingle, len(w))
            parts[k].append(self.keys(w, k))
        self.shingles = {k: np.unique(np.concatenate(v)) for k, v in parts.items()}
        self.anchors: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}

    def keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """The number of each run of k words; -1 where one of them is in no item."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        known, number = np.ones(n, bool), np.zeros(n, np.int64)
        for j in range(k):
            part = ids[j : j + n]
            known &= part >= 0
            number = number * self.base + part
        return np.where(known, number, -1)

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Anchor every window at its rarest shingle; counts: by (length, place in ``shingles``)."""
        found = defaultdict(lambda: defaultdict(list))
        for at, w in enumerate(self.windows):
            k = min(self.shingle, len(w))
            keys = self.keys(w, k)
            places = np.searchsorted(self.shingles[k], keys)
            offset = min(range(len(keys)), key=lambda j: (counts.get((k, int(places[j])), 0), int(keys[j])))
            found[k][int(keys[offset])].append((offset, at))
        self.anchors = {k: (np.array(sorted(v), np.int64), [v[key] for key in sorted(v)]) for k, v in found.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self.vocabulary.get
        return np.fromiter((known(w, -1) for w in words), np.int64, len(words))

    def found(self, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in keys whose number is among the sorted numbers, and its place there."""
        at = np.flatnonzero(keys >= 0)
        place = np.searchsorted(among, keys[at])
        place[place == len(among)] = 0
        good = among[place] == keys[at] if len(among) else np.zeros(len(at), bool)
        return at[good], place[good]

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans [start, end) of the words hit, and the items with a window here."""
        starts, items = [], set()
        for k, (among, owners) in self.anchors.items():
            for at, place in zip(*(x.tolist() for x in self.found(self.keys(ids, k), among))):
                for offset, number in owners[place]:
                    window, start = self.windows[number], at - offset
                    end = start + len(window)
                    if start >= 0 and end <= len(ids) and np.array_equal(ids[start:end], window):
                        starts.append((start, end))
                        items.update(self.owners[number])
        spans: list[tuple[int, int]] = []
        for start, end in sorted(starts):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
        return spans, sorted(items)


def _block(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int, kind: str) -> DataFrame:
    """Spans and items of every row for one block of items."""
    index = Windows(items, window, shingle)

    shared = docs.sparkSession.sparkContext.broadcast(index)  # of one block, so of bounded size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        totals = {k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()}
        for batch in pieces(batches, 0):
            for body in batch.column(0):
                ids = index.ids(words_of(body.as_py()))
                for k, among in index.shingles.items():
                    _, place = index.found(index.keys(ids, k), among)
                    np.add.at(totals[k], place, 1)
        for k, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], names=["k", "place", "n"])

    # bounded: one row for each shingle of the block at most
    counted = docs.select("body").mapInArrow(count, "k bigint, place bigint, n bigint").groupBy("k", "place").agg(F.sum("n").alias("n"))
    index.choose({(r.k, r.place): r.n for r in counted.collect()})

    chosen = docs.sparkSession.sparkContext.broadcast(index)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = chosen.value
        for batch in pieces(batches, 1):
            n_words, hits, items = [], [], []
            for body in batch.column(1):
                words = words_of(body.as_py())
                found, names = index.match(index.ids(words))
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in found])
                items.append(names)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return docs.select("doc_id", "body").mapInArrow(spans, f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged word ranges hit), items (sorted ids as text).

    Null texts have no words. Items without an id or without words have no windows; with no items, no
    document is hit. Repeated documents stay, repeated items count once; further columns are ignored. Documents of any
    length are searched whole, in time and memory in proportion to it.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_bytes(item_text_col).alias("body")).filter("item IS NOT NULL")
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        return _block(source, [(r.item, bytes(r.body)) for r in items.collect()], window, shingle, kind)
    # several blocks: rows get a number, and their spans from all blocks are united
    numbered = materialise(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()
        part = materialise(_block(numbered.select(F.col("row").alias("doc_id"), "body"), [(r.item, bytes(r.body)) for r in block], window, shingle, "bigint"), "block")
        parts = part if parts is None else parts.unionByName(part)
    merge = F.expr(
        "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:bigint,end:bigint>>), (s, x) -> "
        "if(size(s) > 0 and x.start <= element_at(s, -1).end, concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start as start, greatest(element_at(s, -1).end, x.end) as end))), concat(s, array(x))))"
    )
    merged = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), merge.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.select("row", F.col("doc_id").alias("id")).join(merged.withColumnRenamed("doc_id", "row"), "row").select(F.col("id").alias("doc_id"), "n_words", "spans", "items")


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans themselves."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )
