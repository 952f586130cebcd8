"""Line deduplication: a line that several documents hold stays in the first of them only.

Two Bloom filters are made from the hashes of all lines. The first says which were seen once;
a hash that is in it already goes to the second. Tasks fill their own pair and pairs are merged
bit by bit: what two of them have seen once was seen twice. Only lines that the second filter
may hold, the suspected repeats, are shuffled, as full digests, which confirm the repeat and
choose the first document. The filters lose no repeat, so results don't depend on them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.llm.common import PIECE, _slices, quoted, written

#: Fixed values of the contract: white space of keys, and their least length in code points.
SPACE = b" \t\n\x0b\x0c\r"
LEAST = 10

#: Bits of a filter, as a power of two, whatever the size of the input: 64 MB, which bounds what
#: a task holds and what is broadcast. Good for a billion lines (a tenth of the single ones are
#: then suspected); beyond, more is shuffled, up to a digest of every line.
LOG_BITS = 29
HASHES = 2

#: Bits of a page, the piece in which filters are merged: 64 KB.
LOG_PAGE = 19


def keys_of(text: str | None) -> list[bytes]:
    """The key of every line, or an empty one where it is too short to count."""
    lines = (text or "").encode().split(b"\n")
    keys = (line.strip(SPACE) for line in lines)
    return [k.lower() if len(k) >= LEAST and (len(k) >= 4 * LEAST or len(k.decode()) >= LEAST) else b"" for k in keys]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def places(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """The bits of each hash: one row for each of the two hash functions, halves of the hash."""
    mask = np.uint64((1 << log_bits) - 1)
    return np.stack([(hashes & mask), (hashes >> np.uint64(64 - log_bits))][:HASHES]).astype(np.int64)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def see(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, log_bits: int) -> None:
    """Take in hashes, one for each line and document."""
    different, counts = np.unique(hashes, return_counts=True)
    at = places(different, log_bits)
    put(twice, at[:, (counts > 1) | has(once, at)])
    put(once, at)


def pages_of(log_bits: int):
    """Fills a pair of filters from a task's texts and gives their pages that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (log_bits - 3), dtype=np.uint8) for _ in range(2))
        for batch in batches:
            for part in _slices(batch, 0, PIECE):
                distinct = [hashes_of(list(set(keys_of(t)) - {b""})) for t in part.column(0).to_pylist()]
                if distinct:
                    see(once, twice, np.concatenate(distinct), log_bits)
        size = 1 << (min(LOG_PAGE, log_bits) - 3)
        for page in np.flatnonzero(once.reshape(-1, size).any(axis=1)).tolist():
            cut = slice(page * size, (page + 1) * size)
            packed = [pa.array([zlib.compress(x[cut].tobytes(), 1)], pa.binary()) for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), *packed], names=["page", "once", "twice"])

    return run


def merge_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the sorted pages of a partition, one after another; gives the twice-seen ones."""
    at, once, twice = None, None, None
    for batch in batches:
        for page, a, b in zip(batch["page"], batch["once"], batch["twice"]):
            a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
            if page != at:
                if at is not None and twice.any():
                    yield pd.DataFrame({"page": [at], "twice": [zlib.compress(twice.tobytes(), 1)]})
                at, once, twice = page, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None and twice.any():
        yield pd.DataFrame({"page": [at], "twice": [zlib.compress(twice.tobytes(), 1)]})


def seen_twice(docs: DataFrame, text: str = "text", log_bits: int = LOG_BITS) -> dict[int, bytes]:
    """The pages of the filter of hashes seen twice: at most ``2 ** log_bits`` bits in all."""
    texts = docs.select(F.col(quoted(text)).cast("string").alias("text"))
    pages = texts.mapInArrow(pages_of(log_bits), "page int, once binary, twice binary")
    merged = pages.repartition("page").sortWithinPartitions("page").mapInPandas(merge_pages, "page int, twice binary")
    return {r.page: bytes(r.twice) for r in merged.collect()}


class Filter:
    """The filter in a task; unpacked once in a worker, however many tasks it runs."""

    _held: tuple[str, np.ndarray] | None = None

    @classmethod
    def of(cls, shared: Broadcast) -> np.ndarray:
        name, log_bits, pages = shared.value
        if cls._held is None or cls._held[0] != name:
            bits = np.zeros(1 << (log_bits - 3), dtype=np.uint8)
            size = 1 << (min(LOG_PAGE, log_bits) - 3)
            for page, packed in pages.items():
                bits[page * size:(page + 1) * size] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            cls._held = (name, bits)
        return cls._held[1]


def suspected(keys: list[bytes], bits: np.ndarray, log_bits: int) -> set[bytes]:
    """The keys of a text that the filter of hashes seen twice may hold."""
    different = list(set(keys) - {b""})
    if not different:
        return set()
    return {different[k] for k in np.flatnonzero(has(bits, places(hashes_of(different), log_bits))).tolist()}


def suspects_of(shared: Broadcast, log_bits: int):
    """A row for each suspected key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Filter.of(shared)
        for batch in batches:
            for part in _slices(batch, 0, PIECE):
                at, digests = array("q"), []
                for k, text in enumerate(part.column(0).to_pylist()):
                    found = suspected(keys_of(text), bits, log_bits)
                    at.extend([k] * len(found))
                    digests += [hashlib.sha256(x).digest() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(at, pa.int64())) for k in (1, 2)), pa.array(digests, pa.binary())],
                    names=["doc_id", "text_hash", "digest"],
                )

    return run


def unsuspected(shared: Broadcast, log_bits: int, wanted: bool):
    """Only the texts without suspected keys (``wanted``), or only those with some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Filter.of(shared)
        for batch in batches:
            for part in _slices(batch, 0, PIECE):
                clean = [not suspected(keys_of(t), bits, log_bits) for t in part.column(0).to_pylist()]
                yield part.filter(pa.array([x == wanted for x in clean], pa.bool_()))

    return run


def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the lines whose key's digest is among those to drop."""
    for batch in batches:
        for part in _slices(batch, 0, PIECE):
            kept, dropped, counts = [], [], []
            for text, gone in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                gone, lines = set(gone or ()), text.split("\n")
                stay = lines
                if gone:
                    stay = [line for line, k in zip(lines, keys_of(text)) if not k or hashlib.sha256(k).digest() not in gone]
                kept.append("\n".join(stay))
                dropped.append(len(lines) - len(stay))
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"],
            )


def deduplicated_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text", log_bits: int = LOG_BITS) -> DataFrame:
    """``doc_id``, ``text`` without repeated lines, ``n_lines`` before and ``n_dropped``.

    Keys of ten code points or more that at least two documents hold lose all their lines, but
    not in the document with the smallest id. Rows of one id are one document, whose rows each
    keep or lose the line; rows without an id are one as well, and it comes after all others.
    A line that repeats within one document only stays. Null and empty texts are one empty
    line, which is too short to go. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    given = docs.select(
        F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"), F.col(quoted(row_id)).cast("long").alias("doc_id")
    ).withColumn("text_hash", F.xxhash64("text"))
    pages = seen_twice(given, log_bits=log_bits)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, log_bits, pages))
    suspects = written(given.mapInArrow(suspects_of(shared, log_bits), "doc_id long, text_hash long, digest binary"), "suspects")
    # A table of its own: so the line of every document is split between tasks in the join below.
    repeated = written(suspects.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max(F.col("doc_id").isNull()).alias("nameless")
    ).filter((F.col("first_id") < F.col("last_id")) | (F.col("nameless") & F.col("first_id").isNotNull())), "repeated-lines")
    # Grouped by text as well as id, so that a group is never more than the lines of one text.
    gone = (
        suspects.join(repeated, "digest").filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_id")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("digest").alias("gone"))
    )
    touched = given.mapInArrow(unsuspected(shared, log_bits, False), given.schema)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    cut = touched.join(gone, same, "left").select("text", "doc_id", "gone").mapInArrow(
        cut_lines, "doc_id long, text string, n_lines long, n_dropped long"
    )
    whole = given.mapInArrow(unsuspected(shared, log_bits, True), given.schema)
    lines = (F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    return whole.select("doc_id", "text", lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).unionByName(cut)
