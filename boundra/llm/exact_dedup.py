"""Exact deduplication by content-defined chunk recipes.

Each document is read once: its white space is normalised, the bytes are cut where a rolling hash
says so, and every chunk gets a 64-bit identifier with a SHA-256 digest. One pass over the chunk
identifiers verifies that no identifier stands for two different chunks. Documents are then compared
by their ordered identifier lists (recipes); the texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, materialise, pieces, text_bytes

#: Chunk sizes in bytes: least, most; the rolling hash asks for a cut once in 2**AVERAGE_BITS bytes.
LEAST, MOST, AVERAGE_BITS = 512, 16384, 11
#: The rolling hash's byte values; any fixed random table serves.
_GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)
_SPACES = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Replace each run of white space by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    joined = b" ".join(words)
    if text[:1] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
        joined = b" " + joined
    if text[-1] in _SPACES:
        joined += b" "
    return joined


def chunk_ends(text: bytes) -> list[int]:
    """End offsets of the content-defined chunks of ``text``; none for an empty text."""
    size = len(text)
    if size <= LEAST:
        return [size] if size else []
    rolling = _GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):  # a window of 16 bytes by doubling
        wider = rolling.copy()
        wider[step:] += rolling[:-step] << np.uint32(step)
        rolling = wider
    ends, last = [], 0
    for cut in (np.flatnonzero(rolling >> np.uint32(32 - AVERAGE_BITS) == 0) + 1).tolist() + [size]:
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST or cut == size and cut > last:
            ends.append(cut)
            last = cut
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        whole, ids, digests, offsets = [], [], [], [0]
        for body in batch.column(1):
            text = normalise(body.as_py())
            whole.append(hashlib.sha256(text).hexdigest())
            last = 0
            for end in chunk_ends(text):
                digest = hashlib.sha256(text[last:end]).digest()
                ids.append(int.from_bytes(digest[:8], "big", signed=True))
                digests.append(digest[8:24])
                last = end
            offsets.append(len(ids))
        places = pa.array(offsets, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(whole, pa.string()), pa.ListArray.from_arrays(places, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(places, pa.array(digests, pa.binary()))],
            names=["doc_id", "text_sha256", "ids", "digests"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts
    as empty. ``keep_id`` is the smallest id of the group (null only if all its ids are null). Exactly
    one row of a group is kept, also when rows repeat. An empty table gives no rows; further columns
    of ``docs``, whatever their names, are ignored. A text of any length becomes a list of chunks in proportion to it.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))
    recipes = materialise(source.mapInArrow(_recipes, f"doc_id {kind}, text_sha256 string, ids array<bigint>, digests array<binary>"), "recipes")
    # a short identifier is verified when all its chunks have the same digest
    doubtful = (
        recipes.select(F.explode(F.arrays_zip("ids", "digests")).alias("c"))
        .groupBy(F.col("c.ids").alias("id"))
        .agg(F.min("c.digests").alias("low"), F.max("c.digests").alias("high"))
        .filter("low <> high")
    )
    if not doubtful.isEmpty():  # then the digests belong to the identifiers
        recipe = F.struct("ids", "digests")
    else:
        recipe = F.struct("ids")
    rows = recipes.groupBy("doc_id", "text_sha256", recipe.alias("recipe")).agg(F.count(F.lit(1)).alias("copies"))
    groups = materialise(rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        rows.join(groups, "recipe")
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
