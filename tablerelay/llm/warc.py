"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the archives to its
tasks: a task looks for the gzip magic from the start of its range, takes a place as a member
when what is there decodes to a WARC version line, and owns the records that start inside the
range; the last may end behind it. From an owned record on, the next starts where it ends.

Archives lie in a folder that all executors reach, by any address that ``pyarrow.fs`` knows
(local or mounted paths, HDFS, S3, GCS). A task writes to a name of its own and then renames,
so that a repeated task leaves the same archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.llm.common import written

#: Fixed values of the formats.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
RECORD_URN = "urn:tablerelay:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of archive that a reading task owns, and that it fetches at a time.
RANGE, FETCH = 16 << 20, 1 << 20
#: Compressed bytes within which a member shows its version line.
PROBE = 4096

WRITTEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("intact", T.BooleanType()),
])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the response's header, with its length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URN}{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD_URN}{refers_to}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def assigned(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: of equal payloads of ``least`` bytes and more, the
    smallest id is the response that the others refer to, and has null.

    Only ids and digests are grouped and joined, and the pages then meet their own row by id:
    no payload is dealt out by its digest, so a payload that a third of the pages share
    weighs on no task. Null ids are the largest. Of rows with one id and one payload the first
    is a response where the id is, and the others refer to it.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    keyed = {"_id": F.coalesce(F.col(page_id).cast("long"), F.lit(2**63 - 1)), "_digest": F.unhex(F.sha1(body)), "_large": F.octet_length(body) >= least}
    narrow = pages.select(*(c.alias(k) for k, c in keyed.items()))
    pairs = narrow.groupBy("_id", "_digest", "_large").agg(F.count("*").alias("_n"))
    first = pairs.filter("_large").groupBy("_digest").agg(F.min("_id").alias("_first"), F.sum("_n").alias("_all")).filter("_all > 1")
    refers = pairs.filter("_large").join(first.drop("_all"), "_digest").select("_id", "_digest", "_first")
    copy = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_id", "_digest"))
    joined = pages.withColumns(keyed).join(refers, ["_id", "_digest"], "left").withColumn("_copy", copy)
    own = (F.col("_first") == F.col("_id")) & (F.col("_copy") == 1)
    return joined.withColumn("refers_to", F.when(F.col("_first").isNotNull() & ~own, F.col("_first")))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """A plan that writes an archive for each partition, and says which."""
    rows = assigned(pages, page_id, html, least).select(
        F.col(page_id).cast("string").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.when(F.col("refers_to") == 2**63 - 1, F.lit("null")).otherwise(F.col("refers_to").cast("string")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name = f"{place}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, records = f"{name}.{uuid.uuid4().hex}.tmp", 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(4))):
                    page, address, text, refers = (x.as_py() for x in row)
                    out.write(record_bytes("null" if page is None else page, address, text.encode(), refers))
                    records += 1
        size = store.get_file_info(own).size
        if records:
            store.move(own, name)
        else:
            store.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=WRITTEN.names)

    return rows.mapInArrow(write, WRITTEN)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of the archives in a folder: a listing, as the driver makes for any table."""
    store, place = fs.FileSystem.from_uri(folder)
    found = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".warc.gz")]
    return spark.createDataFrame(sorted(found), "path string, bytes long")


def read_archives(spark: SparkSession, folder: str, *, range_bytes: int = RANGE) -> DataFrame:
    """The records of all archives in ``folder``, one row each."""
    files = archives(spark, folder)
    ranges = files.filter("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    tasks = max(1, files.select(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(0))).first()[0])
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as file:
                    for rows in _batched(records(file, start, start + range_bytes)):
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return ranges.repartition(int(tasks)).mapInArrow(scan, RECORD)


_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
])


def _batched(rows: Iterator[dict], most: int = 4 << 20) -> Iterator[list[dict]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"") + 500
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def records(file, start: int, end: int) -> Iterator[dict]:
    """The records of an archive that start in [start, end)."""
    size = file.size()
    at = _next_member(file, start, min(end, size))
    while at is not None and at < end:
        data, after = _member(file, at, size)
        if data is None:
            at = _next_member(file, at + 1, min(end, size))
            continue
        if data.startswith(VERSION):
            yield _parsed(data)
        at = after if after < size else None
        if at is not None and at < end and file.read_at(3, at) != MAGIC:
            at = _next_member(file, at, min(end, size))


def _next_member(file, start: int, end: int) -> int | None:
    """The first place in [start, end) where a member starts that decodes to a record."""
    at = start
    while at < end:
        window = file.read_at(min(FETCH, end - at) + len(MAGIC) - 1, at)
        found = window.find(MAGIC)
        while found >= 0:
            if at + found < end and _head(file, at + found).startswith(VERSION):
                return at + found
            found = window.find(MAGIC, found + 1)
        at += FETCH
    return None


def _head(file, at: int) -> bytes:
    try:
        return zlib.decompressobj(31).decompress(file.read_at(PROBE, at), 64)
    except zlib.error:
        return b""


def _member(file, at: int, size: int) -> tuple[bytes | None, int]:
    """A whole member and where it ends; None where it is broken."""
    decode, out = zlib.decompressobj(31), []
    while not decode.eof:
        chunk = file.read_at(64 << 10, at) if at < size else b""
        if not chunk:
            return None, at
        try:
            out.append(decode.decompress(chunk))
        except zlib.error:
            return None, at
        at += len(chunk) - len(decode.unused_data)
    return b"".join(out), at


def _parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)^content-length: *(\d+)", http, re.MULTILINE)
    kind, digest = fields.get("WARC-Type"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    whole = kind == "response"
    return {
        "record_id": _name(fields.get("WARC-Record-ID")), "record_type": kind, "target_uri": fields.get("WARC-Target-URI"),
        "refers_to": _name(fields.get("WARC-Refers-To")), "payload_digest": digest,
        "payload_bytes": len(payload) if whole else int(told[1]) if told else None, "payload": payload if whole else None,
        "intact": payload_digest(payload) == digest if whole else None,
    }


def _name(urn: str | None) -> str | None:
    return None if urn is None else urn.strip("<>").removeprefix(RECORD_URN)


def page_ids(record_id: str) -> Column:
    """The id that a page's record was named by; null where it had none."""
    return F.when(F.col(record_id) != "null", F.col(record_id).cast("long"))


def archived_pages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in ``folder`` and returns one row a page, read back.

    Null html is an empty payload, null url an empty address. Of equal payloads, empty ones
    too, the smallest page_id is the response; rows that repeat its id and payload revisit it.
    A page without an id comes last of all and reads back without. An empty table gives no
    rows. A response whose payload doesn't have the digest of its header fails the read, and
    so does an archive that gives other records than were written: what is broken or cut off.
    """
    spark = pages.sparkSession
    expected = write_archives(pages, folder, least=least).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    return read_back(spark, folder, expected)


def read_back(spark: SparkSession, folder: str, expected: int) -> DataFrame:
    """The pages of the archives in ``folder``, which must be as many records as ``expected``."""
    if not expected:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    intact = F.when(F.col("intact") | F.col("intact").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("broken payload in record "), F.col("record_id"))))
    found = written(read_archives(spark, folder).select(
        page_ids("record_id").alias("page_id"), "payload_bytes", intact.alias("payload_digest"), "record_type", page_ids("refers_to").alias("refers_to")
    ), "warc-read")
    if (n := found.count()) != expected:
        raise ValueError(f"{expected} records were written to {folder}, {n} were read back")
    return found
