"""Shared helpers: tables, intermediate results in the shared folder, size checks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once.
PIECE = 1 << 20
#: For rows of up to some MB: Parquet's writer looks at the size of pages and row groups after each row instead of every 100, and its row groups,
#: which writers and readers hold in memory, are small.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
_own: list[str] = []
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library gives memory back as it likes
    _libc = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; where that is unset, a folder of a local session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        folder = _own[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step", large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and keeps expensive stages from running twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of tables from materialise() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "__dict__", {}).get("written_at")
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df``, best a written table, has at most so many rows: a count, which no single task makes."""
    return df.count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``df`` was counted to fit; else the join shuffles."""
    return F.broadcast(df) if at_most(df, rows) else df


def bounded_batches(spark: SparkSession, most: int = PIECE) -> None:
    """Let the session's Arrow batches hold at most about so many bytes, unless it asks for less.

    Spark's own bound of 64 MB holds for each of a task's buffers, on both sides of the pipe; the texts of
    the corpus tables, some of them very long, are passed in smaller batches. Nothing else depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """At the end of a task: memory that its Python worker no longer uses goes back, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose texts take at most so many bytes (or one row), as views.

    Work on a text takes a multiple of its size, so larger batches than bounded_batches() asks for are parted.
    """
    try:
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def text_of(raw: bytes | None) -> str:
    """The text of UTF-8 bytes; null is empty, invalid bytes become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""


def strings(column: pa.Array) -> pa.Array:
    """UTF-8 bytes as an Arrow string array, as text_of() reads them."""
    try:
        return pc.fill_null(column.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([text_of(x.as_py()) for x in column], pa.string())


def text_bytes(column: str | Column) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")
