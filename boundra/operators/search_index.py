"""A stored inverted index for text search, and top results without scoring every match.

A segment holds documents sorted by part and about by length and cut into blocks of 64. For each token and block there is one row:
a bit for each of the block's documents that has it, bounds (largest weighted hits, shortest length), and the weighted hits of each bit; a block's documents and
their lengths are one row of another table. Texts move once and rows once, and nothing else of the texts is written. Bits tell
how many documents have any token that begins with a word, and which have all words, from a 64th of the rows; bounds tell which blocks can
hold one of the best. A search reads the folders of the buckets its words fall in.

Documents that change are added as further segments and removed by bits; ``merge_segments`` makes one segment of all. What belongs to
the index is said by a manifest, so a search sees it before a change or after, never in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from boundra.operators.search import tokenised
from boundra.sources.manifest import Manifest
from boundra.sources.storage import written

#: Tokens are in one bucket by their first letters; so many buckets there are.
HEAD, BUCKETS = 3, 64
#: The bucket of the rows of documents until they have a folder of their own.
DOCS = -1
#: Tokens that are put in rows at once, bytes of a batch on its way there, and rows of a batch on its way back.
AT_ONCE, BATCH, ROWS = 1 << 20, 2 << 20, 1 << 15
#: Documents of a range, as far as there are not more ranges than so many for a shuffle partition.
RANGE, RANGES = 1024, 8
#: Blocks of a request that are scored first; each further round takes so many times as many.
FIRST, GROWTH = 4, 4
#: Words, and words of blocks that are scored, up to this number are sent to all tasks.
SENT = 200_000


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a segment. Blocks and documents, of which there may be no file, have their types beside them."""
    if table not in ("blocks", "docs"):
        return spark.read.parquet(f"{path}/{table}")
    own = {"blocks": ["token", "part", "block", "mask", "max_f", "min_length", "fs", "bucket"], "docs": ["part", "block", "docs", "lengths"]}[table]
    return spark.read.schema(spark.read.parquet(f"{path}/types").select(*own).schema).parquet(f"{path}/{table}")


def _shares(tokens: pa.Array, shares: int) -> np.ndarray:
    """Of each token the number of its bucket, by its first letters, times ``shares``, and which share of the bucket it is in."""
    heads = pc.utf8_slice_codeunits(tokens, 0, HEAD).dictionary_encode()
    bucket = np.array([crc32(h.encode()) % BUCKETS for h in heads.dictionary.to_pylist()], np.int64)[np.asarray(heads.indices)]
    return bucket * shares + (np.array([crc32(t.encode(), 1) % shares for t in tokens.to_pylist()], np.int64) if shares > 1 else 0)


def _packed(docs: pa.RecordBatch, group: np.ndarray, shares: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks that follow one another in one part: a row for the tokens of each share of a bucket, compressed, and a row for each block's documents.

    A token has the places of its documents (64 a block), their weighted hits (a byte each where these are small whole numbers) and, for each block, the
    shortest length. ``group`` has the number of each document's block, from 0.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    place = group * 64 + np.arange(len(docs)) - starts[group]
    length, listed, base = np.asarray(docs.column("length")), docs.column("listed"), docs.column("block")[0].as_py()
    part = lambda n: docs.column("part").take(pa.array(np.zeros(n, np.int64)))
    token, w = listed.flatten().flatten()
    token = token.dictionary_encode()
    if len(token):
        share = _shares(token.dictionary, shares)
        order = np.argsort(share, kind="stable")
        share, names = share[order], token.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[np.asarray(token.indices)] * len(docs) + np.repeat(np.arange(len(docs)), np.diff(np.asarray(listed.offsets)))
        key, where = np.unique(key, return_inverse=True)
        f = np.bincount(where, np.asarray(w), len(key))
        word, at = np.divmod(key, len(docs))
        tokens = np.flatnonzero(np.diff(word, prepend=-1, append=-1))  # where a token begins, and the end
        runs = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (group[at][1:] != group[at][:-1])]))
        sizes = np.diff(tokens).astype(np.int32)
        wide = np.logical_or.reduceat((f != np.floor(f)) | (f < 0) | (f > 255), tokens[:-1])
        of_f = np.repeat(wide, sizes)
        in_f = np.repeat(of_f, np.where(of_f, 8, 1))
        hits = np.empty(len(in_f), np.uint8)
        hits[in_f], hits[~in_f] = f[of_f].view(np.uint8), f[~of_f].astype(np.uint8)
        shortest = np.minimum.reduceat(length[at], runs).astype(np.int32)
        place = place[at].astype(np.uint16)
        text, ends = _bytes(names)
        cuts = np.append(np.flatnonzero(np.diff(share, prepend=-1)), len(names))
        to_place, to_hit = tokens[cuts], np.append(0, np.cumsum(np.where(wide, 8, 1) * sizes))[cuts]
        to_run, to_text = np.searchsorted(runs, to_place), np.append(0, np.cumsum(ends))[cuts]
        bodies = []
        for i in range(len(cuts) - 1):
            own, j = slice(cuts[i], cuts[i + 1]), i + 1
            parts = [ends[own], sizes[own], shortest[to_run[i] : to_run[j]], place[to_place[i] : to_place[j]], wide[own], text[to_text[i] : to_text[j]], hits[to_hit[i] : to_hit[j]]]
            bodies.append(np.array([len(x) for x in parts], np.int32).tobytes() + b"".join(x.tobytes() for x in parts))
        firsts = share[cuts[:-1]]
        yield pa.RecordBatch.from_arrays([
            pa.array((firsts // shares).astype(np.int32)), pa.array((firsts % shares).astype(np.int32)), part(len(bodies)), pa.array(np.full(len(bodies), base)), pa.array([len(x) for x in bodies], pa.int32()),
            pa.array([pa.compress(x, "zstd", asbytes=True) for x in bodies], pa.binary()), *(pa.nulls(len(bodies), schema.field(c).type) for c in ("docs", "lengths")),
        ], names=schema.names)
    ends, block, n = pa.array(np.append(starts, len(docs)), pa.int32()), base + np.arange(len(starts)), len(starts)
    lists = [pa.ListArray.from_arrays(ends, docs.column(c)) for c in ("doc", "length")]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DOCS, np.int32)), pa.array((block % shares).astype(np.int32)), part(n), pa.array(block), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *lists], names=schema.names)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings without nulls, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _unpacked(row: dict, part: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a packed row's tokens, one for each token and block."""
    body = pa.decompress(row["body"], row["size"], "zstd", asbytes=True)
    counts, kinds, parts, at = np.frombuffer(body, np.int32, 7), (np.int32, np.int32, np.int32, np.uint16, np.bool_, np.uint8, np.uint8), [], 28
    for n, kind in zip(counts.tolist(), kinds):
        parts.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ends, sizes, shortest, places, wide, text, hits = parts
    places = places.astype(np.int64)
    token = np.repeat(np.arange(len(sizes)), sizes)
    of_f = np.repeat(wide, sizes)
    in_f = np.repeat(of_f, np.where(of_f, 8, 1))
    f = np.empty(len(places))
    f[of_f], f[~of_f] = hits[in_f].view(np.float64), hits[~in_f]
    group = places >> 6
    runs = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
    names = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.append(0, np.cumsum(ends)).astype(np.int32)), pa.py_buffer(text)])
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(token[runs])), part.take(pa.array(np.zeros(len(runs), np.int64))), pa.array(row["block"] + group[runs]), pa.array(np.bitwise_or.reduceat(np.int64(1) << (places & 63), runs)), pa.array(np.maximum.reduceat(f, runs)),
        pa.array(shortest), pa.ListArray.from_arrays(pa.array(np.append(runs, len(places)), pa.int32()), pa.array(f)), *(pa.nulls(len(runs), schema.field(c).type) for c in ("docs", "lengths")), pa.array(np.full(len(runs), row["bucket"], np.int32)),
    ], names=schema.names)


def _packed_rows(listed: DataFrame, shares: int) -> DataFrame:
    """Packed rows of tokens and of documents, made where the documents lie, in the order in which they lie there."""
    part, doc = (listed.schema[c].dataType.simpleString() for c in ("part", "doc"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, schema = [], 0, None
        for batch in batches:
            if schema is None:
                kinds = {c: batch.schema.field(c).type for c in ("part", "doc")}
                schema = pa.schema([("bucket", pa.int32()), ("share", pa.int32()), ("part", kinds["part"]), ("block", pa.int64()), ("size", pa.int32()), ("body", pa.binary()), ("docs", pa.list_(kinds["doc"])), ("lengths", pa.list_(pa.int32()))])
            held.append(batch)
            n += pc.sum(batch.column("length")).as_py() or 0
            if n >= AT_ONCE:
                held, n = [(yield from whole(pa.concat_batches(held), schema, False))], 0
        if sum(map(len, held)):
            yield from whole(pa.concat_batches(held), schema, True)

    def whole(docs: pa.RecordBatch, schema: pa.Schema, last: bool):
        """Rows of all blocks but the last one, which the next batch may go on with; this is returned."""
        block = np.asarray(docs.column("block"))
        part = np.asarray(pc.fill_null(docs.column("part").dictionary_encode().indices, -1))
        new_part = np.concatenate([[False], part[1:] != part[:-1]])  # a block that lies in two parts is two
        firsts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]) | new_part)
        upto = np.append(0, np.cumsum(np.asarray(docs.column("length"), np.int64)))
        ends = np.append(firsts[1:], len(docs))
        k, n = 0, len(firsts) if last else len(firsts) - 1
        while k < n:
            to = k + 1
            while to < n and not new_part[firsts[to]] and to - k < 1024 and upto[ends[to]] - upto[firsts[k]] <= AT_ONCE:
                to += 1
            a, b = int(firsts[k]), int(ends[to - 1])
            yield from _packed(docs.slice(a, b - a), np.repeat(np.arange(to - k), ends[k:to] - firsts[k:to]), shares, schema)
            k = to
        return docs.slice(int(firsts[-1]))

    numbered = listed.withColumn("_id", F.monotonically_increasing_id())
    spelled = f"bucket int, share int, part {part}, block bigint, size int, body binary, docs array<{doc}>, lengths array<int>"
    return numbered.select("part", "doc", "length", F.shiftright("_id", 6).alias("block"), "listed").mapInArrow(packed, spelled)


def _unpacked_rows(packed: DataFrame) -> DataFrame:
    """Rows of tokens and blocks, and of documents, of packed rows."""
    part, docs = (packed.schema[c].dataType.simpleString() for c in ("part", "docs"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = lambda c: (c, batch.schema.field(c).type)
            schema = pa.schema([("token", pa.string()), kind("part"), ("block", pa.int64()), ("mask", pa.int64()), ("max_f", pa.float64()), ("min_length", pa.int32()), ("fs", pa.list_(pa.float64())), kind("docs"), kind("lengths"), ("bucket", pa.int32())])
            of_docs = pc.equal(batch.column("bucket"), DOCS)
            tokens, documents = batch.filter(pc.invert(of_docs)), batch.filter(of_docs)
            made, n = [], 0
            for k, row in enumerate(tokens.select(["bucket", "block", "size", "body"]).to_pylist()):
                made.append(_unpacked(row, tokens.column("part").slice(k, 1), schema))
                n += len(made[-1])
                if n >= ROWS:
                    yield pa.concat_batches(made)
                    made, n = [], 0
            if made:
                yield pa.concat_batches(made)
            if len(documents):
                has = documents.schema.names
                yield pa.RecordBatch.from_arrays([documents.column(c) if c in has else pa.nulls(len(documents), schema.field(c).type) for c in schema.names], names=schema.names)

    return packed.mapInArrow(unpacked, f"token string, part {part}, block bigint, mask bigint, max_f double, min_length int, fs array<double>, docs {docs}, lengths array<int>, bucket int")


def _write_segment(listed: DataFrame, root: str) -> str:
    """A new segment folder of documents (part, doc, listed, length), in the order in which tasks have them; nothing refers to it yet."""
    spark, name = listed.sparkSession, f"segment-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket is in as many tasks as there are for it, so that each writes few files and a large bucket isn't one task's
    rows = _unpacked_rows(_packed_rows(listed, max(1, n // BUCKETS)).repartition(n, "bucket", "share")).sortWithinPartitions("bucket", "token", "part", "block")
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/types")
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))  # whole texts are on their way
    try:
        rows.write.partitionBy("bucket").parquet(f"{path}/blocks")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = at(f"{path}/blocks/bucket={DOCS}")
    if not (fs.rename(made, at(f"{path}/docs")) if fs.exists(made) else fs.mkdirs(at(f"{path}/docs"))):
        raise OSError(f"{path}/docs can't be made")
    lengths = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    _read(spark, path, "docs").groupBy("part").agg(F.sum(F.size("docs")).alias("n"), F.sum(lengths).alias("total")).write.parquet(f"{path}/stats")
    _read(spark, path, "blocks").select("token", "bucket").distinct().repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/vocabulary")
    return name


def _tables(spark: SparkSession, root: str, names: list[str], table: str) -> DataFrame | None:
    """A table of all segments, with the segment each row is of."""
    out = None
    for s in names:
        one = _read(spark, f"{root.rstrip('/')}/{s}", table).withColumn("segment", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def _each(documents: DataFrame) -> DataFrame:
    """(segment, part, block, bit, doc, length)."""
    rows = documents.select("segment", "part", "block", F.posexplode(F.arrays_zip("docs", "lengths")).alias("bit", "d"))
    return rows.select("segment", "part", "block", "bit", F.col("d.docs").alias("doc"), F.col("d.lengths").alias("length"))


def _hits(mask: Column, fs: Column) -> Column:
    """array<struct<bit, f>> of a token's row."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: mask.bitwiseAND(_bit(b)) != 0)
    return F.arrays_zip(bits.alias("bit"), fs.alias("f"))


def _removed(spark: SparkSession, root: str, says: dict) -> DataFrame | None:
    """(segment, part, block, gone): bits of documents that no longer count."""
    gone = _tables(spark, root, says["removed"], "bits")
    return None if gone is None else gone.groupBy("of_segment", "part", "block").agg(F.bit_or("gone").alias("gone")).withColumnRenamed("of_segment", "segment")


def _live(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows of documents (segment, part, block, bit) that aren't removed."""
    if gone is None:
        return rows
    return rows.join(gone, ["segment", "part", "block"], "left").filter(F.col("gone").isNull() | (F.col("gone").bitwiseAND(_bit(F.col("bit"))) == 0)).drop("gone")


def _write_removal(spark: SparkSession, root: str, says: dict, docs: DataFrame) -> str | None:
    """A folder of the bits of documents (part, doc) that are in the index; None if there are none."""
    held = _tables(spark, root, says["segments"], "docs")
    if held is None:
        return None
    found = _live(_each(held), _removed(spark, root, says)).join(docs.select("part", "doc").distinct(), ["part", "doc"], "left_semi")
    name = f"removed-{uuid.uuid4().hex}"
    found = written(found.select(F.col("segment").alias("of_segment"), "part", "block", "bit", "length"), "removed")
    if found.isEmpty():
        return None
    found.groupBy("of_segment", "part", "block").agg(F.bit_or(_bit(F.col("bit"))).alias("gone")).write.parquet(f"{root.rstrip('/')}/{name}/bits")
    found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).write.parquet(f"{root.rstrip('/')}/{name}/stats")
    return name


def _says(manifest: Manifest) -> tuple[int, dict]:
    version, says = manifest.read()
    return version, says or {"segments": [], "removed": []}


def add_documents(docs: DataFrame, root: str, part: str, doc: str, weights: dict[str, float]) -> int:
    """Index documents under ``root``; those that were there under the same part and id are replaced. The index's new version."""
    spark, manifest = docs.sparkSession, Manifest(docs.sparkSession, root)
    version, says = _says(manifest)
    gone = _write_removal(spark, root, says, docs.select(F.col(part).alias("part"), F.col(doc).alias("doc")))
    # texts move once, as they are, by their letters: so they lie about as by their tokens, and a small file isn't one task's. There are more ranges
    # than tasks at a time, as the last ones hold the longest texts
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    letters = sum((F.coalesce(F.length(c), F.lit(0)) for c in weights), F.lit(0))
    docs = docs.select(part, doc, *weights)
    ranges = max(n, min(RANGES * n, docs.count() // RANGE))
    docs = docs.repartitionByRange(ranges, part, letters, doc).sortWithinPartitions(part, letters, doc)
    name = _write_segment(tokenised(docs, part, doc, weights), root)
    return manifest.commit(version, {"segments": [*says["segments"], name], "removed": [*says["removed"], *([gone] if gone else [])]})


def remove_documents(docs: DataFrame, root: str) -> int:
    """Take documents (part, doc) out of the index."""
    manifest = Manifest(docs.sparkSession, root)
    version, says = _says(manifest)
    gone = _write_removal(docs.sparkSession, root, says, docs)
    return version if gone is None else manifest.commit(version, {**says, "removed": [*says["removed"], gone]})


def merge_segments(spark: SparkSession, root: str, clean: bool = True) -> int:
    """One segment of all documents that count; with ``clean``, what it replaces is deleted (no search may still read it)."""
    manifest = Manifest(spark, root)
    version, says = _says(manifest)
    if len(says["segments"]) < 2 and not says["removed"]:
        return version
    place = ["segment", "part", "block", "bit"]
    docs = _live(_each(_tables(spark, root, says["segments"], "docs")), _removed(spark, root, says))
    rows = _tables(spark, root, says["segments"], "blocks")
    hits = rows.select(*place[:3], "token", F.explode(_hits(F.col("mask"), F.col("fs"))).alias("h")).groupBy(*place[:3], F.col("h.bit").alias("bit")).agg(F.collect_list(F.struct("token", F.col("h.f").alias("w"))).alias("listed"))
    none = F.array().cast("array<struct<token:string,w:double>>")
    listed = written(docs.join(hits, place, "left").select("part", "doc", F.coalesce("listed", none).alias("listed"), "length"), "listed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _write_segment(listed.repartitionByRange(n, "part", "length").sortWithinPartitions("part", "length", "doc"), root)
    number = manifest.commit(version, {"segments": [name], "removed": []})
    for old in [*says["segments"], *says["removed"]] if clean else []:
        manifest.delete(f"{manifest.root}/{old}")
    return number


def _worded(rows: DataFrame, words: DataFrame, span: Row) -> DataFrame:
    """Rows of tokens with each word that their token begins with, as often: beginnings join the words, of which few are sent to the rows."""
    if span.a is None:
        return rows.filter("false").withColumn("word", F.col("token"))
    able = rows.filter(F.length("token") >= span.a)
    spread = able.withColumn("_k", F.explode(F.sequence(F.lit(span.a), F.least(F.length("token"), F.lit(span.b))))).withColumn("word", F.expr("substring(token, 1, _k)")).drop("_k")
    return spread.join(F.broadcast(words) if span.n <= SENT else words, "word")


def _term(f: Column, length: Column) -> Column:
    return F.col("idf") * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / F.col("mean_length")))


def search_index(queries: DataFrame, root: str, k: int = 10, scored: bool = False) -> DataFrame:
    """The best ``k`` documents for each request (request_id, words): request_id, part, doc, bm25, rank; lower is better, then the smaller id.

    As a full text search: a document must hold each word as a token's beginning, statistics are those of its part. Blocks
    are taken by the most their documents can score, until no other can reach the ``k``-th best so far; with ``scored``, columns ``postings`` and
    ``matches`` say how many postings were scored for the request and how many there are.
    """
    spark = queries.sparkSession
    _, says = _says(Manifest(spark, root))
    names = says["segments"]
    kept = ["request_id", "part", "doc", "bm25", "rank", *(["postings", "matches"] if scored else [])]
    asked = written(queries.select("request_id", F.size("words").alias("n_words"), F.explode("words").alias("word")), "asked")
    per_word = asked.groupBy("request_id", "n_words", "word").agg(F.count(F.lit(1)).cast("double").alias("times"))
    words = asked.select("word").distinct()
    span = words.agg(F.min(F.length("word")).alias("a"), F.max(F.length("word")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    matched = _worded(_tables(spark, root, names, "vocabulary").drop("segment"), words, span) if names else None
    buckets = sorted(r.bucket for r in matched.select("bucket").distinct().collect()) if names else []  # BUCKETS at most
    if not buckets:
        empty = spark.createDataFrame([], "part int, doc string, bm25 double, rank int, postings bigint, matches bigint")
        return queries.select("request_id").filter("false").crossJoin(empty).select(*kept)
    rows = _tables(spark, root, names, "blocks").filter(F.col("bucket").isin(buckets))
    documents, gone = _tables(spark, root, names, "docs"), _removed(spark, root, says)

    # which documents of a block have a token that begins with a word, and the most they can score by it
    by_word = _worded(rows.drop("fs"), words, span).groupBy("word", "segment", "part", "block").agg(F.bit_or("mask").alias("mask"), F.sum("max_f").alias("max_f"), F.min("min_length").alias("min_length"))
    if gone is not None:
        by_word = by_word.join(gone, ["segment", "part", "block"], "left").withColumn("mask", F.when(F.col("gone").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseAND(F.bitwise_not("gone")))).drop("gone")
    by_word = written(by_word.filter(F.col("mask") != 0), "by_word")
    size = _tables(spark, root, names, "stats").drop("segment")
    if says["removed"]:
        size = size.unionByName(_tables(spark, root, says["removed"], "stats").select("part", (-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
    size = size.groupBy("part").agg(F.sum("n").alias("n_docs"), F.sum("total").alias("total")).select("part", "n_docs", (F.col("total") / F.col("n_docs")).alias("mean_length"))
    raw = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    facts = by_word.groupBy("word", "part").agg(F.sum(F.bit_count("mask")).alias("n")).join(size, "part").select("word", "part", "n", "mean_length", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf"))
    facts = written(facts, "facts")

    bound = _term(F.col("max_f"), F.col("min_length")) * F.col("times") * (1 + 1e-9)
    blocks = per_word.join(by_word, "word").join(facts.drop("n"), ["word", "part"]).groupBy("request_id", "n_words", "segment", "part", "block").agg(
        F.sum(bound).alias("bound"), F.bit_and("mask").alias("mask"), F.sum("times").alias("found")
    )
    blocks = blocks.filter((F.col("found") == F.col("n_words")) & (F.col("mask") != 0)).drop("found", "n_words")
    own = Window.partitionBy("request_id")
    blocks = written(blocks.withColumn("place", F.row_number().over(own.orderBy(F.desc("bound"), "segment", "part", "block"))), "blocks")
    last = blocks.agg(F.max("place").alias("n")).first().n or 0

    def score(now: DataFrame) -> DataFrame:
        """Every document of these blocks that holds all words, with its score and how many postings that took."""
        able = now.select("request_id", "segment", "part", "block", F.col("mask").alias("able"))
        lying = able.select("segment", "part", "block").distinct()
        wanted = able.join(per_word.select("request_id", "word", "times"), "request_id")
        few = wanted.count() <= SENT
        here = rows.select("token", "segment", "part", "block", "mask", "fs").join(F.broadcast(lying) if few else lying, ["segment", "part", "block"], "left_semi")
        held = _worded(here, words, span).join(F.broadcast(wanted) if few else wanted, ["word", "segment", "part", "block"]).filter(F.col("mask").bitwiseAND(F.col("able")) != 0)
        items = held.select("request_id", "word", "times", "segment", "part", "block", F.explode(F.filter(_hits(F.col("mask"), F.col("fs")), lambda i: F.col("able").bitwiseAND(_bit(i["bit"])) != 0)).alias("i"))
        sums = items.groupBy("request_id", "word", "times", "segment", "part", "block", F.col("i.bit").alias("bit")).agg(F.sum("i.f").alias("f"), F.count(F.lit(1)).alias("postings"))
        known_as = documents.join(F.broadcast(lying) if few else lying, ["segment", "part", "block"], "left_semi")
        hits = sums.join(known_as, ["segment", "part", "block"]).withColumns({"doc": F.get("docs", F.col("bit")), "length": F.get("lengths", F.col("bit"))}).drop("docs", "lengths")
        terms = hits.join(facts.drop("n"), ["word", "part"])
        return terms.groupBy("request_id", "part", "doc").agg((-F.sum(_term(F.col("f"), F.col("length")) * F.col("times"))).alias("bm25"), F.sum("postings").alias("postings"))

    done, upto, best, counts, threshold = 0, FIRST, None, None, None
    while done < last:
        now = blocks.filter((F.col("place") > done) & (F.col("place") <= upto))
        if threshold is not None:  # equal scores may still go by the smaller id
            now = now.join(threshold, "request_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8)).drop("least")
        now = written(now, "now")
        if now.isEmpty():
            break
        fresh = written(score(now), "scored")
        counts = fresh.select("request_id", "postings") if counts is None else counts.unionByName(fresh.select("request_id", "postings"))
        pool = fresh.drop("postings") if best is None else best.drop("rank").unionByName(fresh.drop("postings"))
        best = written(pool.withColumn("rank", F.row_number().over(own.orderBy(F.round("bm25", 9), "doc", "part"))).filter(F.col("rank") <= k), "best")
        threshold = F.broadcast(best.filter(F.col("rank") == k).select("request_id", (-F.col("bm25")).alias("least")))
        done, upto = upto, upto * GROWTH
    if best is None:
        doc = _each(documents).select("part", "doc").limit(0)
        best = blocks.select("request_id").filter("false").crossJoin(doc).select("*", F.lit(0.0).alias("bm25"), F.lit(0).alias("rank"))
    if scored:
        total = per_word.join(by_word.groupBy("word").agg(F.sum(F.bit_count("mask")).alias("n")), "word").groupBy("request_id").agg(F.sum("n").alias("matches"))
        taken = counts.groupBy("request_id").agg(F.sum("postings").alias("postings")) if counts is not None else best.select("request_id", F.lit(0).cast("bigint").alias("postings"))
        best = best.join(taken, "request_id").join(total, "request_id")
    return best.select(*kept)
