"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Writing goes through Spark's text writer, so the archives lie wherever Spark can write. Reading scans
each archive for everything that looks like a record start - also inside payloads - and emits the
candidate's offset with the offset of its successor. Pointer jumping from offset 0 of each file, which
doubles its reach in every round, retains only the records on the true chain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.llm.common import broadcast_if, materialise, new_path

#: Payloads of at least so many bytes are stored once; records and bytes in one archive file, at most.
REVISIT_BYTES, RECORDS, FILE_BYTES = 1000, 4000, 64 << 20
#: Records of each of these sizes and less go to files of their own, so that few long ones don't make all files short.
SIZES = [16 << 10, 256 << 10, 4 << 20]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where a url stands encoded that has control characters, or blanks at its ends.
URL_FIELD = "WARC-Target-URI-Encoded"
_UNFIT = r"[\x00-\x1f\x7f]|^\s|\s$|^$"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_FIELDS = [("file", "string"), ("offset", "bigint"), ("next", "bigint"), ("record_id", "string"), ("record_type", "string"), ("url", "string"), ("refers_to", "string"), ("stated_digest", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string")]
_SCHEMA = ", ".join(f"{n} {t}" for n, t in _FIELDS)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", records: int = RECORDS) -> None:
    """Write one record per row; null html is an empty payload.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the largest id are responses
    and the others revisit that id; smaller payloads are all responses. Repeated rows are records of
    their own. A row without an id is a record without a number and is never revisited by others. Ids
    are percent-encoded, whatever is in them, the empty one too. A url that no header line can hold as it is stands
    there without its control characters, and encoded in a field of its own, from which it is read back whole.
    A file holds at most ``records`` records and FILE_BYTES bytes, or a single longer record.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = source.withColumn("size", F.octet_length("html")).withColumn("key", F.sha2("html", 256))
    copies = keyed.filter(F.col("size") >= REVISIT_BYTES).groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keep IS NOT NULL")
    copies = broadcast_if(materialise(copies.select("key", "keep"), "copies"), 500_000)
    rows = keyed.join(copies, "key", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page>"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f]", "%0A"))),
        F.when(F.col("url").rlike(_UNFIT), line(URL_FIELD, F.url_encode("url"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", urn(F.col("keep"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(header, block, F.lit("\r\n\r")).alias("value")
    # a record's bytes at most: a byte of the url becomes three at most, and may stand there twice; two ids and fixed lines come in addition
    long = lambda c: F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("bigint")
    bytes_of = lambda html: long(html) + 6 * long(F.col("url"))
    most = source.agg(F.max(bytes_of(F.col("html"))).alias("bytes"), F.max(long(F.col("page_id"))).alias("id")).first()
    fixed = 1000 + 2 * 3 * (most["id"] or 0)
    low, longest = 0, (most["bytes"] or 0) + fixed
    for high in [*[x for x in SIZES if x < longest], longest]:
        some = rows if high == longest and not low else rows.filter((bytes_of(F.col("html")) + fixed > low) & (bytes_of(F.col("html")) + fixed <= high))
        # the writer ends each value with a line feed, the last of the record's four closing bytes
        some.select(value).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", max(1, min(records, FILE_BYTES // high))).text(path)
        low = high


def _parse(content: bytes, start: int, stop: int):
    """Fields, body and end of a candidate whose header ends at ``stop``, or None if its length doesn't lead to the end of a record."""
    fields = {}
    for line in content[start:stop].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    body, end = stop + 4, stop + 4 + int(length)
    if content[end : end + 4] != b"\r\n\r\n":
        return None
    return fields, body, end


def _records(content: bytes) -> Iterator[tuple[int, dict, int, int]]:
    """Start, fields, body and end of everything that looks like a record, however long its header."""
    stop, good = -1, False
    for match in _START.finditer(content):
        start = match.start()
        # all starts before a blank line share it and their last lines: where the first is none, none is
        first = start > stop
        if first:
            stop = content.find(b"\r\n\r\n", start)
            if stop < 0:
                return
        elif not good:
            continue
        parsed = _parse(content, start, stop)
        if first:
            good = parsed is not None
        if parsed:
            yield start, *parsed


def _url(fields: dict) -> str | None:
    said = fields.get(URL_FIELD.lower().encode())
    return fields.get(b"warc-target-uri") if said is None else unquote_plus(said)


def _payload(content: bytes, fields: dict, body: int, end: int) -> tuple[int, int]:
    """Where the payload begins, and the size its HTTP header states (-1: none)."""
    if fields.get(b"content-type", "").startswith("application/http"):
        split = content.find(b"\r\n\r\n", body, end)
        if split >= 0:
            stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", content[body : split + 2])
            return split + 4, int(stated[1]) if stated else -1
    return body, -1


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = value.as_py()
            for start, fields, body, end in _records(content):
                at, stated = _payload(content, fields, body, end)
                kind, said = fields.get(b"warc-type", ""), fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
                whole = kind != "revisit"
                rows.append((
                    file, start, end + 4, fields.get(b"warc-record-id"), kind, _url(fields), fields.get(b"warc-refers-to"), said,
                    end - at if whole else stated, hashlib.sha1(content[at:end]).hexdigest() if whole else said,
                ))
        columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "bigint" else pa.string()) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def chain(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that are reached from offset 0 of their file."""
    here = candidates.select("file", "offset")
    jumps = candidates.select("file", F.col("offset").alias("a"), F.col("next").alias("b")).join(here.withColumnRenamed("offset", "b"), ["file", "b"], "left_semi")
    state = materialise(
        jumps.select("file", "a", "b").unionByName(here.filter("offset = 0").select("file", F.col("offset").alias("a"), F.lit(None).cast("bigint").alias("b"))), "chain"
    )
    while not state.filter("b IS NOT NULL").isEmpty():
        # rows with b are jumps of 2**k records, rows without are reached starts; both double
        jumps, reached = state.filter("b IS NOT NULL"), state.filter("b IS NULL").select("file", "a")
        further = reached.join(jumps, ["file", "a"]).select("file", F.col("b").alias("a"))
        wider = jumps.select("file", "a", F.col("b").alias("m")).join(jumps.select("file", F.col("a").alias("m"), "b"), ["file", "m"]).select("file", "a", "b")
        state = materialise(reached.unionByName(further).withColumn("b", F.lit(None).cast("bigint")).unionByName(wider), "chain")
    return state.select("file", F.col("a").alias("offset"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains of all archive files under ``path``, one row each.

    Files are read whole and at most 2 GB each. A file that is empty, or doesn't start with a
    record, gives none; after a broken record the rest of its file is not reached.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "content")
    candidates = materialise(files.mapInArrow(_candidates, _SCHEMA), "candidates")
    return candidates.join(chain(candidates), ["file", "offset"], "left_semi")


def read_payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """file, offset and payload (text) of the given records that hold one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                content, starts, texts = value.as_py(), [], []
                for start, fields, body, end in _records(content):
                    starts.append(start)
                    texts.append(content[_payload(content, fields, body, end)[0] : end].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["file", "offset", "payload"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "content")
    wanted = records.filter("record_type <> 'revisit'").select("file", "offset")
    return files.mapInArrow(cut, "file string, offset bigint, payload string").join(wanted, ["file", "offset"], "left_semi")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    number = lambda c: F.expr(f"CASE WHEN {c} LIKE '<urn:page:%' THEN try_cast(try_url_decode(regexp_extract({c}, '^<urn:page:(.*)>$', 1)) AS {kind}) END")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"), "url"
    )
