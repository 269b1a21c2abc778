"""N-gram Jaccard join with token-combination prefixes, and the classes it links.

Every document is the set of its distinct word shingles, as 63-bit numbers: two different shingles have the same
with probability 2**-63, so that a set of a million shingles is one too small once in ten million sets. Equal sets
(by 128-bit digests) form one class, and only its smallest document goes on. Tokens get one order for all sets:
rare before frequent, then by number. A pair at the threshold shares at least s tokens of its prefixes
if these are s - 1 longer than the usual ones. Rare tokens are indexed alone (one shared token is enough), frequent
ones in pairs. A prefix with frequent tokens is extended by s - 1 tokens and these are dealt into s - 1 parts by
their numbers: of s shared frequent tokens, two lie in the same part and make a shared pair. As s grows with the
set, a part keeps its size, and a set of any length has signatures in proportion to its length.

Sets with a common signature are compared with one set of that signature only, that which shares most with
others. What these links connect need not be compared again; signatures whose sets still lie in several
components go on with another partner while that links much, and at last all pairs between different
components are compared, those of large signatures block by block. No link that joins two components is
missed, and no group's pairs are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import at_most, bounded_batches, discard, give_back, materialise, pieces, text_bytes

SHINGLE, PERCENT = 4, 85
#: Rounds with one partner for each signature, at most, before all pairs between components are compared.
ROUNDS = 4
#: Signatures of more classes than LARGE are compared by clusters, in blocks of about BLOCK classes.
LARGE, BLOCK = 200, 256
#: Tokens of the usual prefix to a part that frequent tokens are dealt into, about.
PART = 16
#: A token in more prefixes than this is frequent; remembered word numbers per worker; rows sent to all tasks at most.
FREQUENT, MEMORY, SENT = 32, 200_000, 2_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Numbers(dict):
    """Words' 64-bit numbers, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


_numbers = _Numbers()


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted numbers of the distinct shingles of ``size`` words; of all words as one if there are fewer."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not words:
        return np.zeros(0, np.uint64)
    number = np.array(list(map(_numbers.__getitem__, words)), np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ number[k : k + n]) * _M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1))  # 63 bits: the same order as signed numbers


def _prefix(n: np.ndarray | int, percent: int):
    """Length of the usual prefix: n minus the least overlap with any partner, plus one."""
    return n - (percent * n + 99) // 100 + 1


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _linked(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the smallest node of each component.

    Every node points to the smallest node in its reach; pointers are followed to their own pointers in
    each round, so the rounds grow with the logarithm of a component's diameter.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        labels, before = labels.select("node", "root"), labels
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = materialise(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialise(step.join(far, "root").select("node", "old", F.least("root", "far").alias("root")), "labels")
        discard(before, step)
        labels = new
        if new.filter("old <> root").isEmpty():
            discard(both)
            return new


def _sets(source: DataFrame, reps: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the wanted nodes, made again from the texts of their representatives only."""
    chosen = materialise(reps.join(wanted, "node", "left_semi").select("node", "digest", "doc_id"), "chosen")
    few = at_most(chosen, SENT)
    ids = chosen.select("doc_id")
    rows = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("body")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in pieces(batches, 0):
                found = [shingle_set(x.as_py(), size) for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), _lists(found)], names=["digest", "tokens"])
        finally:
            _numbers.clear()  # workers live on
            give_back()

    # ids may repeat with other texts, so the set's digest decides; rows that repeat as a whole are no harm but work
    made = rows.mapInArrow(sets, "digest binary, tokens array<bigint>")
    nodes = chosen.select("digest", "node")
    found = materialise(made.join(F.broadcast(nodes) if few else nodes, "digest").select("node", "tokens"), "sets")
    discard(chosen)
    return found


def _verified(pairs: DataFrame, reps: DataFrame, source: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    First by the heads, the smallest tokens of each set: up to the smaller of two heads' ends both sets are
    known, and what lies beyond can't overlap by more than the shorter rest. The whole sets are made and
    moved only for pairs that this bound leaves.
    """
    heads = reps.select("node", "n", "sketch")
    known = (
        pairs.select("a", "b")
        .join(heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("of_b")), "b")
        .join(heads.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("of_a")), "a")
    )
    end = lambda s, n: F.when(F.size(s) < F.col(n), F.element_at(s, -1)).otherwise(F.lit(2**63 - 1))
    upto = F.least(end(F.col("of_a"), "n_a"), end(F.col("of_b"), "n_b"))
    known = known.withColumn("upto", upto)
    rest = lambda s, n: F.col(n) - F.size(F.filter(F.col(s), lambda x: x <= F.col("upto")))
    most = F.size(F.array_intersect("of_a", "of_b")) + F.least(rest("of_a", "n_a"), rest("of_b", "n_b"))
    likely = materialise(known.filter((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "likely")
    nodes = materialise(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "nodes")
    tokens = _sets(source, reps, nodes, size)
    discard(nodes)
    found = (
        likely.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("of_b")), "b")
        .join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("of_a")), "a")
        .withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    )
    enough = 100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))
    links = materialise(found.filter(enough).select("a", "b").distinct(), "links")
    discard(likely, tokens)
    return links


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _parts_of(n: int, percent: int) -> set[int]:
    """Into how many parts frequent tokens of a set of n are dealt: once for each scale that it shares with a partner.

    Sizes from one power of two to the next are of one scale. Partners differ by less than a factor of two, so
    the smaller one reaches the scale of the larger.
    """
    scale = 1 << (n.bit_length() - 1)
    scales = [scale, 2 * scale] if 100 * n >= percent * 2 * scale else [scale]
    return {max(1, _prefix(x, percent) // PART) for x in scales}


def _index(tokens: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a whole set: single rare tokens and pairs of frequent ones in its prefix."""
    n = len(tokens)
    length = _prefix(n, percent)
    ordered = np.concatenate([tokens[~often], tokens[often]])
    rare = n - int(often.sum())
    if length <= rare:
        return ordered[:length]
    found = [ordered[:rare]]
    for parts in _parts_of(n, percent):
        some = ordered[rare : length + parts]
        part = (some * _M3 >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        for own in np.split(some[order], np.flatnonzero(np.diff(part[order])) + 1):
            x, y = np.triu_indices(len(own), 1)
            pairs = (own[x] * _M2) ^ (own[y] * _M3)
            pairs ^= pairs >> np.uint64(31)
            found.append(pairs * _M1)
    return np.unique(np.concatenate(found))


def _signatures(reps: DataFrame, common: DataFrame, source: DataFrame, percent: int, size: int) -> list[DataFrame]:
    """(sig, node, n) of every class that can be linked with another, as one or two tables."""
    spark = reps.sparkSession
    few = at_most(common, SENT)
    # sorted numbers, eight bytes each, of checked size
    shared = spark.sparkContext.broadcast(np.sort(common.toArrow().column(0).to_numpy())) if few else None
    schema = "sig bigint, node bigint, n bigint"

    def member(tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
        if not len(often):
            return np.zeros(len(tokens), bool)
        at = np.searchsorted(often, tokens)
        at[at == len(often)] = 0
        return often[at] == tokens

    def marked(rows: DataFrame, column: str) -> DataFrame:
        """node, n, tokens, often: with the frequent tokens of each row if they aren't sent to all tasks."""
        rows = rows.select("node", "n", F.col(column).alias("tokens"))
        if few:
            return rows.withColumn("often", F.lit(None).cast("array<bigint>"))
        own = rows.select("node", F.explode("tokens").alias("token")).join(common, "token", "left_semi").groupBy("node").agg(F.collect_list("token").alias("often"))
        return rows.join(own, "node", "left")

    def make(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, short, counts = [], [], batch.column(1).to_pylist()
                for k, n in enumerate(counts):
                    tokens = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                    often = member(tokens, shared.value if few else np.sort(np.array(batch.column(3)[k].as_py() or [], np.int64)))
                    if whole or len(tokens) == n:
                        out.append(_index(tokens.view(np.uint64), often, percent))
                    else:
                        rare = tokens[~often][: _prefix(n, percent)]
                        short.append(len(rare) < _prefix(n, percent))
                        out.append(rare.view(np.uint64) if not short[-1] else np.zeros(0, np.uint64))
                        if short[-1]:
                            out[-1] = np.zeros(1, np.uint64)  # sig 0 with n < 0: the head doesn't decide
                            counts[k] = -n
                sizes = [len(x) for x in out]
                at = pa.array(np.repeat(np.arange(len(out)), sizes))
                flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(at), pa.array(np.repeat(np.array(counts, np.int64), sizes), pa.int64())], names=["sig", "node", "n"])

        return run

    least = -(-percent // max(1, 100 - percent))  # smaller sets are linked with equal ones only
    first = materialise(marked(reps.filter(F.col("n") >= least), "head").mapInArrow(make(False), schema), "signatures")
    open_nodes = materialise(first.filter("n < 0").select("node"), "open")
    if open_nodes.isEmpty():
        discard(open_nodes)
        return [first]
    sets = _sets(source, reps, open_nodes, size)
    tokens = sets.withColumn("n", F.size("tokens").cast("bigint"))
    rest = materialise(marked(tokens.dropDuplicates(["node"]), "tokens").mapInArrow(make(True), schema), "signatures")
    discard(open_nodes, sets)
    return [first, rest]


def _fits(percent: int) -> Column:
    return 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")


def _stars(placed: DataFrame, by: Column, percent: int, done: DataFrame | None) -> DataFrame:
    """(a, b): each class with the one of the largest ``by`` of each of its signatures, if in another component and not ``done``."""
    top = F.max(F.struct(by.alias("by"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))).alias("hub")
    hubs = materialise(placed.groupBy("sig").agg(top).select("sig", "hub.b", "hub.n_b", "hub.root_b"), "hubs")
    pairs = placed.join(hubs, "sig").filter((F.col("node") != F.col("b")) & (F.col("root") != F.col("root_b")) & _fits(percent))
    pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    found = materialise(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(hubs)
    return found


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their component ``root``, of signatures whose classes lie in several components; ``c`` rows each."""
    placed = materialise(buckets.join(labels, "node", "left").select("sig", "node", "n", "weight", F.coalesce("root", "node").alias("root")), "placed")
    mixed = materialise(placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y").select("sig", "c"), "mixed")
    found = materialise(placed.join(mixed, "sig"), "mixed_rows")
    discard(placed, mixed)
    return found


def _rest(placed: DataFrame, reps: DataFrame, source: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between components: every pair with a common signature that isn't in one component yet.

    Pairs of small signatures are joined. The classes of large ones are put together into clusters, and
    each cluster is compared block by block: a task holds two blocks, counts all their common tokens by
    one matrix product, and gives out no more links than it takes to connect what belongs together.
    """
    small = placed.filter(F.col("c") <= LARGE)
    right = small.select(F.col("sig").alias("sig_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    on = (F.col("sig") == F.col("sig_b")) & (F.col("node") > F.col("b")) & (F.col("root") != F.col("root_b")) & _fits(percent)
    pairs = materialise(small.join(right, on).select(F.col("node").alias("a"), "b").distinct(), "rest")
    few = _verified(pairs, reps, source, percent, size)
    discard(pairs)
    large = materialise(placed.filter(F.col("c") > LARGE), "large")
    if large.isEmpty():
        discard(large)
        return few
    hubs = materialise(large.groupBy("sig").agg(F.min("node").alias("b")), "hubs")
    clusters = _linked(large.join(hubs, "sig").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
    sizes = clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    roots = large.select("node", F.col("root").alias("component")).distinct()
    members = clusters.select("node", F.col("root").alias("cluster")).join(sizes, "cluster").join(roots, "node")
    members = materialise(members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    tokens = _sets(source, reps, members.select("node"), size)
    held = members.join(tokens.dropDuplicates(["node"]), "node").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("cluster", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "node", "component", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        # only pairs between components count, and one link for each pair of them is enough
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        lists = table.column("tokens").combine_chunks()
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten().to_numpy()
        distinct, number, count = np.unique(flat, return_inverse=True, return_counts=True)
        number = (np.cumsum(count > 1) - 1)[number] * (count > 1)[number] - (count <= 1)[number]  # -1: in one set only
        row = np.repeat(np.arange(len(node)), length)
        row, number = row[number >= 0], number[number >= 0]
        common = np.zeros((len(node), len(node)), np.float32)
        for start in range(0, int((count > 1).sum()), 20_000):
            on = (number >= start) & (number < start + 20_000)
            part = np.zeros((len(node), min(20_000, int((count > 1).sum()) - start)), np.float32)
            part[row[on], number[on] - start] = 1
            common += part @ part.T
        enough = 100 * common >= percent * (length[:, None] + length[None, :] - common)
        a, b = np.nonzero(np.triu(enough & (component[:, None] != component[None, :]), 1))
        root = {int(c): int(c) for c in component}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for p, q in zip(a.tolist(), b.tolist()):
            x, y = find(int(component[p])), find(int(component[q]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((max(node[p], node[q]), min(node[p], node[q])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    links = materialise(held.groupBy("cluster", "x", "y").applyInArrow(compare, "a bigint, b bigint"), "links")
    discard(large, hubs, clusters, members, tokens)
    return few.unionByName(links)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets, equal
    sets included; component_id is the smallest id reached by links. Texts without a word, or null,
    have empty sets and stand alone. Repeated rows, and rows that repeat an id with another text, stay
    as rows of their own. A row without an id is linked with nothing and its component is null. An empty
    table gives no rows; further columns are ignored. Texts of any length are compared whole: a long one costs
    time and memory in proportion to its length.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in pieces(batches, 1):
                sets = [shingle_set(x.as_py(), size) for x in batch.column(1)]
                # twice the usual prefix: what moves up when frequent tokens go to the end
                heads = [x[: 2 * _prefix(len(x), percent) + 2] for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), _lists(heads)], names=["doc_id", "n", "digest", "head"]
                )
        finally:
            _numbers.clear()
            give_back()

    rows = materialise(source.mapInArrow(facts, f"doc_id {kind}, n bigint, digest binary, head array<bigint>"), "facts")
    able = "n > 0 AND doc_id IS NOT NULL"
    # one class for equal sets
    grouped = rows.filter(able).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min_by("head", "doc_id").alias("head"))
    # nodes are numbers from here on; they are fixed as the table is written
    reps = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "reps")
    reps = reps.withColumn("sketch", F.slice("head", 1, F.greatest(F.lit(1), F.ceil(F.size("head") / 2).cast("int"))))
    common = materialise(reps.select(F.explode("head").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > frequent).select("token"), "frequent")
    written = _signatures(reps, common, source, percent, size)
    signatures = reduce(DataFrame.unionByName, written).filter("n > 0")
    shared = materialise(signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    counted = materialise(signatures.join(shared, "sig"), "buckets")  # only what two or more classes have
    discard(common, shared, *written)
    # of near copies, the one most like all others shares most with them
    weight = materialise(counted.groupBy("node").agg(F.sum("c").alias("weight")), "weight")
    buckets = materialise(counted.join(weight, "node").select("sig", "node", "n", "weight"), "buckets")
    discard(counted, weight)
    links = labels = done = None
    placed = buckets.withColumn("root", F.col("node"))
    by = F.col("weight")
    for turn in range(1, ROUNDS + 1):
        pairs = _stars(placed, by, percent, done)
        new = _verified(pairs, reps, source, percent, size)
        found, tried = new.count(), pairs.count()
        links = new if links is None else links.unionByName(new)
        done = pairs if done is None else done.unionByName(pairs)
        if found or labels is None:
            discard(labels)
            labels = _linked(links)
        discard(placed)
        placed = _mixed(buckets, labels.select("node", "root"))
        by = F.xxhash64("node", F.lit(turn))
        if found < 0.1 * tried:  # further partners would add little
            break
    rest = _rest(placed, reps, source, percent, size)
    if not rest.isEmpty():
        discard(labels)
        labels = _linked(links.unionByName(rest))
    discard(buckets, placed)
    placed = materialise(reps.select("node", "digest", "doc_id").join(labels.select("node", "root"), "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root")), "placed")
    least = materialise(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    found = materialise(placed.join(least, "root").select("digest", "component_id"), "components")
    discard(labels, placed, least)
    lone = rows.filter(f"NOT ({able})").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter(able).select("doc_id", "n", "digest").join(found, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(lone)
