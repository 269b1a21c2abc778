"""Vector code compression: product quantisation with per-dimension value dictionaries, in whole numbers.

Vectors are packed once into blocks. A block keeps, for each dimension, the distinct whole numbers that occur
there and each vector's place among them, as a column store would. To assign the parts of a block, the squared
differences of each *distinct* number to all entries are tabulated, one dimension at a time, and a part's
distances are gathered from these tables by the dictionary codes and added. A table has at most as many rows
as its block has vectors, so nothing grows with the number of values in the data.

Each round adds up components by entry in its task, one row for each entry and task goes through the shuffle,
and the driver gets the sums of the entries, whose number is fixed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boundra.llm.common import discard, give_back, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block: 8192 vectors of 64 dimensions.
BLOCK = 8192 * 64
#: Vectors whose distances are added up together, so that they stay in the cache.
_AT_ONCE = 512
#: Labels up to this number are sent to all tasks with their sums, 16 bytes each and the label's value.
LABELS = 100_000
_LONG, _LIMB = 2**63 - 1, 30


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite numbers: int64 where squares of a vector's differences can't overflow, else Python ints."""
    values = np.asarray(values, np.float64)
    if values.size == 0 or np.abs(values).max() * SCALE < 2**24:
        return np.floor(values * SCALE).astype(np.int64)
    own = [int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in values.ravel().tolist()]  # exact: a power of two
    return np.array(own, object).reshape(values.shape)


def _pack(numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each dimension's sorted distinct numbers, and all codes (dimension, vector)."""
    found = [np.unique(numbers[:, d], return_inverse=True) for d in range(numbers.shape[1])]
    return [values for values, _ in found], np.array([places.ravel() for _, places in found], np.int32).reshape(numbers.shape[1], len(numbers))


def assign(dictionaries: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the first of equals, and squared distance of each part: both (part, vector). ``books``: (part, entry, position)."""
    parts, entries, width = books.shape
    nearest, distance = np.empty((parts, codes.shape[1]), np.int64), np.empty((parts, codes.shape[1]), books.dtype)
    for p in range(parts):
        tables = [(dictionaries[d][:, None] - books[p, :, d - p * width][None, :]) ** 2 for d in range(p * width, (p + 1) * width)]
        for first in range(0, codes.shape[1], _AT_ONCE):
            some = slice(first, first + _AT_ONCE)
            total = sum(table[codes[p * width + k, some]] for k, table in enumerate(tables))
            nearest[p, some] = total.argmin(1)  # the first of equals
            distance[p, some] = total[np.arange(len(total)), nearest[p, some]]
    return nearest, distance


def _stored(values: np.ndarray) -> bytes:
    """A dictionary's numbers: int64, or behind a first byte of 1 decimal digits."""
    return b"\0" + values.tobytes() if values.dtype != object else b"\1" + ",".join(map(str, values)).encode()


def _loaded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64, offset=1) if raw[:1] == b"\0" else np.array([int(x) for x in raw[1:].split(b",")], object)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows that have a vector, all of whose components are finite numbers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", x.alias("embedding"), "label").filter(F.col("embedding").isNotNull() & finite)


def _blocks(kept: DataFrame, size: int) -> DataFrame:
    """Packed blocks of vectors of ``size`` components: their rows' ids and labels, and a dictionary and codes for each dimension."""
    rows = kept.select("vec_id", "label", "embedding")
    id_type, label_type = rows.schema["vec_id"].dataType, rows.schema["label"].dataType
    schema = T.StructType([
        T.StructField("vec_ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)),
        T.StructField("dictionaries", T.ArrayType(T.BinaryType())), T.StructField("codes", T.BinaryType()),
    ])
    most = max(1, BLOCK // max(size, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            ids, labels, lists = (t.column(i).combine_chunks() for i in range(3))
            flat = np.asarray(lists.flatten(), np.float64)
            values, codes = _pack(whole_numbers(flat).reshape(len(ids), size))
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels),
                pa.array([[_stored(v) for v in values]], pa.list_(pa.binary())), pa.array([codes.tobytes()], pa.binary()),
            ], names=schema.names)

        held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - held)
                waiting.append(part)
                at, held = at + part.num_rows, held + part.num_rows
                if held == most:
                    yield block()
                    waiting, held = [], 0
        if held:
            yield block()
        give_back()

    return rows.mapInArrow(pack, schema)


def _block(dictionaries: list[bytes], codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    values = [_loaded(raw) for raw in dictionaries]
    if any(v.dtype == object for v in values):
        values = [v.astype(object) for v in values]
    return values, np.frombuffer(codes, np.int32).reshape(len(values), -1)


def _books(books: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """The codebooks in the block's kind of number, or Python ints if they need them."""
    large = values[0].dtype == object or max(abs(int(books.max())), abs(int(books.min()))) > 2**24
    return books if large else books.astype(np.int64)


def _limbs(x: int) -> list[str]:
    """A sum in parts of _LIMB digits, the lowest first, which decimal columns add up however many there are."""
    out = []
    while abs(x) >= 10**_LIMB:
        x, low = divmod(x, 10**_LIMB)
        out.append(str(low))
    return [*out, str(x)]


def _sums(blocks: DataFrame, books: np.ndarray, size: int) -> dict[tuple[int, int], tuple[list[int], int]]:
    """By part and entry: the componentwise sums of the parts assigned to it, and their count."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for dictionaries, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, codes = _block(dictionaries, raw)
                nearest, _ = assign(values, codes, _books(books, values))
                for p in range(parts):
                    counts[p] += np.bincount(nearest[p], minlength=entries)
                    order = np.argsort(nearest[p], kind="stable")
                    firsts = np.flatnonzero(np.diff(nearest[p][order], prepend=-1))
                    for k in range(width):
                        d = p * width + k
                        sums[p, nearest[p][order[firsts]], k] += np.add.reduceat(values[d][codes[d]][order], firsts).astype(object)
        ps, es = np.nonzero(counts)
        if len(ps):
            digits = [[_limbs(x) for x in sums[p, e]] for p, e in zip(ps, es)]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(es, pa.int32()), pa.array(counts[ps, es], pa.int64()), pa.array(digits, pa.list_(pa.list_(pa.string())))], names=["part", "entry", "n", "sums"])
        give_back()

    found = blocks.select("dictionaries", "codes").mapInArrow(add, "part int, entry int, n long, sums array<array<string>>")
    places = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "limbs")).select("part", "entry", "n", "place", F.posexplode("limbs").alias("limb", "digits"))
    sums = places.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("digits").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    counts: dict[tuple[int, int], int] = {}
    for part, entry, place, limb, n, total in sums.collect():  # a row for each component of the codebooks, more for very large numbers
        out.setdefault((part, entry), [0] * width)[place] += int(total) * 10 ** (_LIMB * limb)
        counts[part, entry] = max(n, counts.get((part, entry), 0))  # each row has a first limb
    return {k: (v, counts[k]) for k, v in out.items()}


def learn_codebooks(kept: DataFrame, blocks: DataFrame, size: int) -> np.ndarray:
    """(part, entry, position), Python ints: the first vectors by id, moved ``ROUNDS`` times to the floor of their parts' means."""
    first = [r.embedding for r in kept.filter(F.size("embedding") == size).orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()]
    books = whole_numbers(np.array(first)).astype(object).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for (part, entry), (sums, n) in _sums(blocks, books, size).items():
            books[part, entry] = [x // n for x in sums]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the kept rows of ``vectors`` (vec_id, embedding, label).

    A row is kept if its vector and all of its components are there and finite. All vectors have the
    length of that with the smallest id (ids repeat or are null: then of equal ids the smallest vector, nulls last);
    a kept vector of another length, or any if that length isn't a multiple of 4, has null code and error, which
    count nothing in its label's sum. Empty vectors have the code ``00000000`` and no error. Codebooks have as many
    entries as there are vectors, if these are fewer than 256; each repeated row gets the same code. An error that a long can't hold is null. An empty table
    gives no rows; further columns are ignored.
    """
    kept = materialise(kept_vectors(vectors), "vectors")
    least = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).limit(1).collect()
    size = least[0].n if least else 0
    fits = F.size("embedding") == size if size % PARTS == 0 else F.lit(False)
    id_type, label_type = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    blocks = None
    if not least or size % PARTS or size == 0:
        code = F.when(fits & (F.size("embedding") == 0), F.lit("00" * PARTS))
        coded, sha = kept.select("vec_id", "label", code.alias("code"), F.when(code.isNotNull(), F.lit(0).cast("long")).alias("error")), hashlib.sha256(b"").hexdigest()
    else:
        blocks = materialise(_blocks(kept.filter(fits), size), "blocks")
        books = learn_codebooks(kept, blocks, size)
        sha = digest(books)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    values, codes = _block(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                    nearest, distance = assign(values, codes, _books(books, values))
                    marks = np.array([f"{e:02x}" for e in range(books.shape[1])], object)
                    errors = pa.array([x if x <= _LONG else None for x in distance.astype(object).sum(0)], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(marks[nearest].sum(0), pa.string()), errors], names=schema.names)
            give_back()

        coded = blocks.mapInArrow(code, schema).unionByName(kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = materialise(coded, "coded")
    # sums are made in the tasks first; few labels go to all tasks, many are joined with the hot ones split by AQE
    by_label = materialise(coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0).cast("long")).alias("label_error")).withColumnRenamed("label", "of_label"), "labels")
    if by_label.count() <= LABELS:
        by_label = F.broadcast(by_label)
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["of_label"]))
    discard(kept, blocks)
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
