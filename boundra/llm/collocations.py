"""Phrase collocation mining with broadcast double-array tries.

Texts are cut once into words and kept as chunks, each with a dictionary of its distinct words; from the
dictionaries come the frequent words, and with their numbers the chunks become arrays of numbers, in which 0
stands for the end of a piece and for words that no frequent phrase can hold. Then, for each length k from 2:

1. *Candidates* must have a frequent beginning and a frequent end of k - 1 words (Apriori): a text position is
   marked with the number of the frequent phrase that begins there, so both are two neighbouring marks. To
   leave out most rare ones, occurrences are counted by hash class first, and only candidates of a class that
   reaches the threshold are kept (Park, Chen and Yu): a class counts at least what each of its phrases does,
   so no frequent phrase is lost, whatever the number of classes.
2. Candidates go into double-array tries of at most ``SHARD`` phrases, broadcast one after the other; all
   positions of a chunk advance through a trie together, one word after the other, and accepting states are
   counted with bincount. Tasks give a row a phrase, which Spark sums: these are the exact frequencies.
3. The frequent ones are marked in the texts, and words outside them go, so texts shrink from level to level.

Scores and containment are joins of the small tables of frequent phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, discard, give_back, materialise, text_bytes
from boundra.llm.double_array import DoubleArray

#: Phrases of a trie and words of a dictionary that are broadcast at once; more make more passes.
SHARD = 1 << 19
#: Bytes of text of a chunk. A longer piece, if nothing in it separates pieces, is a chunk of its own.
CHUNK = 1 << 20
#: Words of a row of texts as numbers, which a longer piece may pass: 256 kB, below what a JVM of a few GB puts into regions of their own.
LOT = 1 << 16
#: Longer words are told by their SHA-256 in the broadcast dictionary.
WORD_BYTES = 64
#: Occurrences of pairs or classes that a task holds before it passes them on, and rows of a batch of these.
HELD, _ROWS = 1 << 21, 1 << 16
#: Phrases are told apart by so many bits before they are candidates; a bit for each class is broadcast, 16 MB.
CLASS_BITS = 27
LONGEST = 5

_FORM = bytearray(range(256))
_FORM[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FORM[_c] = 10
_FORM[9] = 32
_FORM = bytes(_FORM)


def key_of(word: bytes) -> bytes:
    """A word, or its digest behind a blank, which no word has."""
    return word if len(word) <= WORD_BYTES else b" " + hashlib.sha256(word).digest()


def words_of(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of text in which line ends separate pieces and blanks words; and its words' numbers from 1, 0 between pieces."""
    a = np.frombuffer(raw, np.uint8)
    ends_piece = a == 10
    between = ends_piece | (a == 32)
    edges = np.flatnonzero(np.diff(between, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[~between])]).dictionary_encode()
    piece = np.cumsum(ends_piece)[starts]
    breaks = np.diff(piece, prepend=piece[0]) > 0
    codes = np.zeros(len(starts) + np.count_nonzero(breaks), np.int32)
    codes[np.arange(len(starts)) + np.cumsum(breaks)] = np.asarray(words.indices) + 1
    return words.dictionary.cast(pa.binary()), codes


def _parts(text: bytes) -> Iterator[bytes]:
    """Text in parts of about a chunk, cut between pieces."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(b"\n", at, at + CHUNK)
        cut = cut if cut >= 0 else text.find(b"\n", at + CHUNK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def chunks_of(docs: DataFrame) -> DataFrame:
    """lang, words, counts, n_words, codes, ids (null as yet): texts of one language a row."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes("text").alias("text"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            words, codes = words_of(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            counts = np.bincount(codes, minlength=len(words) + 1)[1:].astype(np.int32)
            ends = pa.array([0, len(words)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([lang]), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array([int(counts.sum())], pa.int64()),
                pa.array([codes.tobytes()], pa.binary()), pa.array([None], pa.list_(pa.int32())),
            ], names=["lang", "words", "counts", "n_words", "codes", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _parts(text.as_py().translate(_FORM)):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= CHUNK:
                        yield out(lang)
            while sum(sizes.values()) >= 4 * CHUNK:
                yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)
        give_back()

    return given.mapInArrow(chunk, "lang string, words array<binary>, counts array<int>, n_words long, codes binary, ids array<int>")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with a column ``number`` from 1 without gaps; no task sees more than its own rows."""
    written = materialise(df.withColumn("_raw", F.monotonically_increasing_id()), name)
    spark, counts = df.sparkSession, {}
    for part, n in written.groupBy(F.shiftright("_raw", 33).alias("part")).count().collect():  # one row a partition
        counts[part] = n
    ends = np.cumsum([counts[p] for p in sorted(counts)]) if counts else np.zeros(0, np.int64)
    before = [int(end - counts[p]) for p, end in zip(sorted(counts), ends)]
    # an Arrow table is a local relation; from a list, executors would start Python workers of another kind, which stay beside these
    offsets = spark.createDataFrame(pa.table({"part": pa.array(sorted(counts), pa.int64()), "before": pa.array(before, pa.int64())}))
    out = written.join(F.broadcast(offsets), F.shiftright("_raw", 33) == F.col("part")).withColumn("number", (F.col("before") + F.col("_raw").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_raw", "part", "before")
    out.rows, out.written_at = int(ends[-1]) if len(ends) else 0, written.written_at
    return out


def _shards(table: DataFrame, *columns: str) -> Iterator[pa.Table]:
    """Rows of a numbered table, at most SHARD at once, brought to the driver to be broadcast."""
    for first in range(0, table.rows, SHARD):
        yield table.filter((F.col("number") > first) & (F.col("number") <= first + SHARD)).select(*columns).toArrow()


def _grams(part: pa.Table, column: str = "ids") -> np.ndarray:
    lists = part.column(column).combine_chunks()
    return np.asarray(lists.flatten()).reshape(len(part), -1)


def _kept(ids: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with 0 for what isn't needed, one 0 for many; and which places these are."""
    places = needed.copy()
    places[1:] |= needed[:-1]
    return np.where(needed, ids, 0)[places], places


def _spread(marked: np.ndarray, length: int) -> np.ndarray:
    """Words that belong to a phrase of ``length`` words that begins at a marked place."""
    out = marked.copy()
    for j in range(1, length):
        out[j:] |= marked[:-j] if j < len(marked) else False
    return out


def _beside(marked: np.ndarray) -> np.ndarray:
    """Marked places next to a marked one."""
    out = np.zeros_like(marked)
    out[1:] |= marked[:-1]
    out[:-1] |= marked[1:]
    return out & marked


def _lots(text: np.ndarray) -> Iterator[np.ndarray]:
    """Text in parts of at most ``LOT`` words (or one piece), cut between pieces."""
    zeros, at = np.append(np.flatnonzero(text == 0), len(text)), 0
    while at < len(text):
        k = int(np.searchsorted(zeros, at + LOT, "right")) - 1
        cut = int(zeros[max(k, int(np.searchsorted(zeros, at)))])
        if cut > at:
            yield text[at:cut]
        at = cut + 1


def encode(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ids, marks (binary, int32): texts as numbers of frequent words, one pass for SHARD words; marks are null, as a word's mark is its number."""
    sc = chunks.sparkSession.sparkContext

    def pass_of(shared, last):
        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    lang, words, codes, before = (batch.column(c)[i] for c in range(4))
                    book = shared.value.get(lang.as_py(), {})
                    ids = np.asarray(before.values, np.int32).copy() if before.is_valid else np.zeros(len(words), np.int32)
                    for k, word in enumerate(words.as_py()):
                        found = book.get(key_of(word))
                        if found:
                            ids[k] = found
                    if not last:
                        ends = pa.array([0, len(ids)], pa.int32())
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["lang", "words", "codes", "ids"])
                        continue
                    text = np.concatenate([[0], ids]).astype(np.int32)[np.frombuffer(codes.as_py(), np.int32)]
                    text, _ = _kept(text, _beside(text > 0))
                    for lot in _lots(text):
                        yield pa.RecordBatch.from_arrays([pa.array([lot.tobytes()], pa.binary()), pa.array([None], pa.binary())], names=["ids", "marks"])
            give_back()

        return look_up

    step, shared = chunks.select("lang", "words", "codes", "ids"), []
    parts = list(range(0, vocabulary.rows, SHARD)) or [0]
    for number, part in enumerate(_shards(vocabulary, "lang", "key", "number")) if vocabulary.rows else [(0, None)]:
        book: dict[str, dict[bytes, int]] = {}
        for lang, key, k in zip(*(part.column(c).to_pylist() for c in range(3))) if part is not None else ():
            book.setdefault(lang, {})[key] = k
        shared, last, old = sc.broadcast(book), number == len(parts) - 1, step
        done = step.mapInArrow(pass_of(shared, last), "ids binary, marks binary" if last else "lang string, words array<binary>, codes binary, ids array<int>")
        step = materialise(done, "texts", large_rows=True)
        discard(chunks if number == 0 else old)
        shared.unpersist()
    return step


def _neighbours(batch: pa.RecordBatch, i: int, length: int) -> np.ndarray:
    """Places of phrases of ``length`` words with a frequent beginning and end: the beginning's number and the last word's."""
    ids, marks = np.frombuffer(batch.column(0)[i].as_py(), np.int32), batch.column(1)[i].as_py()
    marks = ids if marks is None else np.frombuffer(marks, np.int32)
    at = np.flatnonzero((marks[:-1] > 0) & (marks[1:] > 0))
    return marks[at].astype(np.int64) << 32 | ids[at + length - 1]


def _class_of(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def _tallied(batches: Iterator[pa.RecordBatch], keys_of, emit) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a task's rows with their counts, at most about ``HELD`` at once, in batches of bounded size."""

    def out() -> Iterator[pa.RecordBatch]:
        for first in range(0, len(keys), _ROWS):
            yield emit(keys[first : first + _ROWS], counts[first : first + _ROWS])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        more = np.concatenate(waiting)
        waiting.clear()
        more.sort()
        firsts = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]]))
        more, n = more[firsts], np.diff(firsts, append=len(more))
        del firsts
        if not len(keys):
            return more, n
        at = np.searchsorted(keys, more)
        known = keys[np.minimum(at, len(keys) - 1)] == more
        counts[at[known]] += n[known]
        fresh = ~known
        return np.insert(keys, at[fresh], more[fresh]), np.insert(counts, at[fresh], n[fresh])

    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            waiting.append(keys_of(batch, i))
            held += len(waiting[-1])
            if held >= HELD // 4:
                keys, counts = merged()
                held = 0
                if len(keys) > HELD // 2:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
    if held:
        keys, counts = merged()
    yield from out()
    del keys, counts, waiting
    give_back()


def _heavy_classes(texts: DataFrame, length: int, least: int) -> np.ndarray:
    """A bit for each hash class whose phrases of ``length`` words occur ``least`` times in all."""

    bits = CLASS_BITS

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = lambda keys, counts: pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(counts, pa.int64())], names=["class", "n"])
        return _tallied(batches, lambda batch, i: _class_of(_neighbours(batch, i, length), bits), emit)

    sums = texts.select("ids", "marks").mapInArrow(classes, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    packed = sums.groupBy(F.shiftright("class", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, class & 63))").alias("bits")).toArrow()  # a row for 64 classes
    heavy = np.zeros(1 << max(0, bits - 6), np.int64)
    heavy[np.asarray(packed.column(0), np.int64)] = np.asarray(packed.column(1), np.int64)
    return heavy


def _few(texts: DataFrame) -> DataFrame:
    """Texts in as few tasks as keep all cores busy: each gives a row for every candidate it sees, and holds no more for having more texts."""
    return texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)


def candidates(texts: DataFrame, frequent: DataFrame, length: int, least: int) -> DataFrame:
    """Numbered phrases of ``length`` words, ``ids``, that may occur ``least`` times: no frequent one is missing."""
    sc = texts.sparkSession.sparkContext
    shared, bits = sc.broadcast(_heavy_classes(texts, length, least)), CLASS_BITS

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value

        def keys_of(batch, i):
            found = _neighbours(batch, i, length)
            c = _class_of(found, bits)
            return found[heavy[c >> 6] >> (c & 63) & 1 > 0]

        emit = lambda keys, _: pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))], names=["beginning", "last"])
        return _tallied(batches, keys_of, emit)

    found = _few(texts.select("ids", "marks")).mapInArrow(pairs, "beginning int, last int").distinct()
    out = numbered(found.join(frequent.select("number", "ids"), F.col("beginning") == F.col("number")).select(F.concat("ids", F.array("last")).alias("ids")), "candidates")
    shared.unpersist()
    return out


def count_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """number, n: exact occurrences of numbered phrases in the texts, a pass for each trie."""
    spark, out = texts.sparkSession, None
    for part in _shards(phrases, "ids", "number"):
        shared = spark.sparkContext.broadcast((DoubleArray(_grams(part)), np.asarray(part.column("number"), np.int32)))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, numbers = shared.value
            total, found, held = np.zeros(len(numbers), np.int64), [np.zeros(0, np.int32)], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    found.append(trie.walk(np.frombuffer(batch.column(0)[i].as_py(), np.int32))[1])
                    held += len(found[-1])
                    if held >= HELD // 4:
                        total += np.bincount(np.concatenate(found), minlength=len(numbers))
                        found, held = found[:1], 0
            total += np.bincount(np.concatenate(found), minlength=len(numbers))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[seen]), pa.array(total[seen])], names=["number", "n"])
            give_back()

        sums = materialise(_few(texts.select("ids")).mapInArrow(count, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")), "counts")
        shared.unpersist()
        out = sums if out is None else out.unionByName(sums)
    return out


def mark(texts: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """Texts with the numbers of the frequent phrases of ``length`` words where they begin; words that no longer phrase can hold go."""
    spark = texts.sparkSession
    firsts = list(range(0, frequent.rows, SHARD))
    for number, part in enumerate(_shards(frequent, "ids", "number")):
        shared = spark.sparkContext.broadcast((DoubleArray(_grams(part)), np.asarray(part.column("number"), np.int32)))

        def marked(batches: Iterator[pa.RecordBatch], shared=shared, first=number == 0, last=number == len(firsts) - 1) -> Iterator[pa.RecordBatch]:
            trie, numbers = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column(0)[i].as_py(), np.int32)
                    marks = np.zeros_like(ids) if first else np.frombuffer(batch.column(1)[i].as_py(), np.int32).copy()
                    at, rows = trie.walk(ids)
                    marks[at] = numbers[rows]
                    if last:
                        useful = _beside(marks > 0)
                        ids, places = _kept(ids, _spread(useful, length))
                        marks = np.where(useful, marks, 0)[places].astype(np.int32)
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary())], names=["ids", "marks"])
            give_back()

        old, texts = texts, materialise(texts.mapInArrow(marked, "ids binary, marks binary"), "texts", large_rows=True)
        discard(old)
        shared.unpersist()
    return texts


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary (lang, word, number, f), all frequent phrases of 1 to ``longest`` words (ids, f), and word counts (lang, n)."""
    chunks = materialise(chunks_of(docs), "chunks", large_rows=True)
    totals = materialise(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    words = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    key = F.when(F.length("word") <= WORD_BYTES, F.col("word")).otherwise(F.concat(F.unhex(F.lit("20")), F.unhex(F.sha2("word", 256))))
    vocabulary = numbered(words.withColumn("key", key), "vocabulary")
    texts = encode(chunks, vocabulary)
    frequent = vocabulary.select("number", F.array("number").alias("ids"), "f")
    frequent.rows = vocabulary.rows
    found = frequent.select("ids", "f")
    for length in range(2, longest + 1):
        if not frequent.rows:
            break
        offered = candidates(texts, frequent, length, least)
        if not offered.rows:
            break
        counts = count_phrases(texts, offered).filter(F.col("n") >= least)
        frequent = numbered(offered.join(counts, "number").select("ids", F.col("n").alias("f")), "frequent")
        found = found.unionByName(frequent.select("ids", "f"))
        if length < longest and frequent.rows:
            texts = mark(texts, frequent, length)
        discard(offered)
    discard(texts)
    return vocabulary, materialise(found, "found"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score; see op12's contract.

    A null language is ``und``, a null text empty; repeated rows count each. Words and texts may be of any length; memory
    grows with the longest piece, not the longest text. Ties go by frequency, then by the phrase's bytes. A
    phrase may not be valid UTF-8 if its text isn't. An empty table gives no rows; further columns are ignored.
    Scores are exact while 1000 * a * n and l * r have at most 38 digits.
    """
    vocabulary, found, totals = frequent_phrases(docs, least, longest)
    phrases = found.filter(F.size("ids") > 1)
    # a longer phrase that occurs as often holds one of one word more that does, too
    ends = phrases.filter(F.size("ids") > 2).select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f").distinct()
    left = phrases.join(ends, ["ids", "f"], "left_anti")
    cuts = left.select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, size(ids) - k)"))
    parts = cuts.join(found.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(found.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    of_words = vocabulary.select(F.col("number"), "lang", F.col("word"))
    parts = parts.join(of_words.select("number", "lang"), F.col("ids")[0] == F.col("number")).drop("number").join(totals, "lang")
    score = F.expr("cast(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)")
    best = parts.withColumn("score", score).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("ids", F.posexplode("ids").alias("at", "number")).join(of_words.select("number", "word"), "number").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"))
    phrase = F.concat_ws(" ", F.transform("ws", lambda w: w["word"].cast("string"))).alias("phrase")
    named = best.join(spelled.select("ids", phrase), "ids").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
