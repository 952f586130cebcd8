"""Near-duplicates by 64-bit SimHash and covering locality-sensitive hashing.

Fingerprints link at RADIUS or fewer differing bits. Bit ``i`` of a fingerprint has a nonzero
vector of RADIUS + 1 bits, and table ``v`` (any nonzero vector) keeps the bits whose product
with ``v`` is odd. The vectors of four differing bits span at most four dimensions of five, so
some ``v`` is orthogonal to all of them, and in its table the two fingerprints are equal: every
pair within the radius meets. Fingerprints are compared inside the buckets of the 31 tables,
which give a spanning tree, not pairs.

A bucket of more than LARGEST fingerprints is not compared. Its members go another way that
is as exact and grows in proportion to them: each emits every fingerprint within half the
radius, and two are within the radius just when they have one of these in common. Such buckets
are taken out before the shuffle, so that no task gets one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.llm.common import add_columns, components, written

#: Fixed values of the contract.
SHINGLE, SEED, RADIUS = 4, 42, 4

#: Where comparing a bucket's members costs more than their 2,081 neighbours each.
LARGEST = 4096
#: Large buckets are foreseen on one in so many fingerprints. That only chooses between two
#: exact ways: a bucket that is missed is found when it is read.
SAMPLE = 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SEGMENT = 1 << 20


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; null and no words give zero."""
    data = (text or "").encode().lower()  # of bytes, which lowers A-Z alone
    ones, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for segment in _segments(data):
        words = carry + segment.split()
        if len(words) >= SHINGLE:
            ones += _ones(words)
            total += len(words) - SHINGLE + 1
        carry = words[-(SHINGLE - 1):]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _segments(data: bytes) -> Iterator[bytes]:
    """A long text piece by piece, cut at white space."""
    start = 0
    while len(data) - start > _SEGMENT:
        cut = _SPACE.search(data, start + _SEGMENT)
        if not cut:
            break
        yield data[start:cut.start()]
        start = cut.start()
    yield data[start:]


def _ones(words: list[bytes]) -> np.ndarray:
    """How often each bit, lowest first, is set in the hashes of the words' shingles."""
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the same 64 bits as a signed number."""

    def make():
        def work(texts):
            values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    return add_columns(docs, text, T.StructType([T.StructField("fingerprint", T.LongType())]), make)


def masks() -> list[int]:
    """The bits that each table keeps, as signed numbers."""
    vectors = [bit % (2 ** (RADIUS + 1) - 1) + 1 for bit in range(64)]
    kept = [sum(1 << bit for bit in range(64) if (vectors[bit] & v).bit_count() % 2) for v in range(1, 2 ** (RADIUS + 1))]
    return [_signed(x) for x in kept]


def neighbours() -> list[int]:
    """What differs from zero in no more than half the radius of bits."""
    return [_signed(sum(1 << b for b in some)) for n in range(RADIUS // 2 + 1) for some in combinations(range(64), n)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


NONE = np.array([], dtype=np.int64)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def _trees(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and the root each is connected to by links within the radius."""
    left, a, b = fps, [NONE], [NONE]
    while len(left) > 1:
        root, left, edge = left[0], left[1:], [left[0]]
        while edge and len(left):
            near = _near(left, np.int64(edge.pop()))
            if near.any():
                found = left[near]
                a.append(found)
                b.append(np.full(len(found), root))
                edge.extend(found.tolist())
                left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def bucket_links(batches: Iterator[pd.DataFrame], largest: int = LARGEST) -> Iterator[pd.DataFrame]:
    """From rows sorted by bucket: ``a`` and its root ``b``, or ``b`` null for the members of
    a bucket of more than ``largest``. Between batches so many rows are held at most."""
    held, held_key, large = NONE, None, False
    for batch in batches:
        table, key, fp = (batch[c].to_numpy() for c in ("table", "key", "fp"))
        if not len(fp):
            continue
        bounds = np.concatenate([[0], np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1, [len(fp)]])
        sizes, trees, crowd = np.diff(bounds), [], []
        first = fp[: bounds[1]]
        if held_key == (table[0], key[0]):
            first = np.concatenate([held, first])
        else:
            trees.append(_trees(held))
            large = False
        if large or len(first) > largest:
            crowd.append(first)
            first, large = NONE, True
        if len(sizes) > 1:
            trees.append(_trees(first))
            for i in np.flatnonzero(sizes[1:-1] > 2) + 1:
                members = fp[bounds[i]:bounds[i + 1]]
                if len(members) > largest:
                    crowd.append(members)
                else:
                    trees.append(_trees(members))
            twos = bounds[1:-2][sizes[1:-1] == 2]
            near = _near(fp[twos], fp[twos + 1])
            trees.append((fp[twos + 1][near], fp[twos][near]))
            first, large = fp[bounds[-2]:], sizes[-1] > largest
            if large:
                crowd.append(first)
                first = NONE
        held, held_key = first, (table[-1], key[-1])
        yield _links(trees, crowd)
    yield _links([_trees(held)], [])


def _links(trees: list, crowd: list) -> pd.DataFrame:
    lone = np.concatenate([NONE, *crowd])
    a = np.concatenate([*(t[0] for t in trees), lone])
    b = pd.array(np.concatenate([*(t[1] for t in trees), lone]), dtype="Int64")
    b[len(a) - len(lone):] = pd.NA
    return pd.DataFrame({"a": a, "b": b})


def first_of_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by ``key`` and ``fp``: each with the first of its key."""
    key_before, first = None, None
    for batch in batches:
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
        if not len(fp):
            continue
        begins = np.concatenate([[True], np.diff(key) != 0])
        firsts = fp[np.maximum.accumulate(np.where(begins, np.arange(len(fp)), 0))]
        if key_before is not None and key[0] == key_before:
            firsts[key == key_before] = first
        key_before, first = key[-1], firsts[-1]
        yield pd.DataFrame({"a": fp, "b": firsts})[fp != firsts]


def links(fingerprints: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``a``, ``b`` of signed fingerprints: enough links to connect all that the radius does.

    ``fingerprints``: distinct values in ``fp``.
    """
    tables = F.array(*(F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks())))
    in_buckets = lambda fps: fps.select("fp", F.explode(tables).alias("t")).select("t.table", "t.key", "fp")
    few = fingerprints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
    large = written(
        in_buckets(few).groupBy("table", "key").count().filter(F.col("count") * SAMPLE > largest).select("table", "key"), "simhash-large"
    )
    buckets = in_buckets(fingerprints)
    found = written(
        buckets.join(large, ["table", "key"], "left_anti").repartition("table", "key").sortWithinPartitions("table", "key", "fp")
        .mapInPandas(lambda rows: bucket_links(rows, largest), "a long, b long"), "simhash-links"
    )
    foreseen = buckets.join(large, ["table", "key"], "left_semi").select("fp")
    crowd = found.filter("b is null").select(F.col("a").alias("fp")).unionByName(foreseen).distinct()
    around = crowd.select("fp", F.explode(F.array(*map(F.lit, neighbours()))).alias("d")).select(F.col("fp").bitwiseXOR(F.col("d")).alias("key"), "fp")
    shared = around.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(first_of_key, "a long, b long")
    return found.filter("b is not null").unionByName(shared).distinct()


def near_classes(rows: DataFrame) -> DataFrame:
    """``fingerprint``, its component's least fingerprint and ``component_id``, for rows of
    doc_id and fingerprint."""
    fps = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    fps = written(fps, "fingerprints")
    grouped = components(links(fps.select("fp")), "a", "b", "simhash")
    placed = written(
        fps.join(grouped, fps["fp"] == grouped["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-components"
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "component").select(F.col("fp").alias("fingerprint"), "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id it is linked to.

    Null and wordless texts have fingerprint zero and are linked like any other. Null ids are
    left out of the smallest; where a component has no id, it is null. Repeated rows stay. An
    empty table gives no rows; other columns are not read.
    """
    rows = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "simhash")
    return rows.join(near_classes(rows), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document
    with the smallest doc_id (a null id counts as the largest), and one row of those that
    repeat both id and text."""
    last = F.lit(2**63 - 1)
    marks = {"_id": F.coalesce(F.col("doc_id").cast("long"), last), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    rows = written(
        with_fingerprint(docs.select("doc_id", "text").withColumns(marks)).select("doc_id", "_id", "_hash", "fingerprint"), "simhash-stage"
    )
    stay = rows.join(near_classes(rows), "fingerprint").groupBy("component").agg(F.min(F.struct("_id", "_hash")).alias("w")).select("w.*")
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id", "_hash"))
    kept = docs.withColumns(marks).join(stay, ["_id", "_hash"]).withColumn("_copy", copy).filter("_copy = 1")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
