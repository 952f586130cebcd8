"""Exact deduplication against a minimal perfect hash of the digests seen before.

The index has one row per part of the digest space. In a part, every historical digest owns
one slot, found without keys: level by level, digests that hash alone to a bit take it, the
others go on to the next level, and the slot is the number of set bits before. A slot holds
the whole digest and where the winner is, so a lookup compares bytes and can't be wrong.

Incoming rows are combined in their own tasks and looked up; members are counted to their
slot, and nonmembers are grouped by digest apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.llm.common import written

#: Digests of a part, on average. A part is what one task holds at a time: about 2 MB.
PART = 32_768

INDEX = T.StructType([
    T.StructField("part", T.LongType()),
    T.StructField("level_bits", T.ArrayType(T.LongType())),
    T.StructField("bits", T.BinaryType()),
    T.StructField("slots", T.BinaryType()),
    T.StructField("winners", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())),
])
FOUND = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("part", T.LongType()),
    T.StructField("slot", T.LongType()),
    T.StructField("top_id", T.LongType()),
    T.StructField("n", T.LongType()),
])


def digest_rows(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Id and 32-byte SHA-256 of every row's whole text, null counting as empty."""
    return docs.select(
        F.col(row_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
    )


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("long").alias("part")


def words_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 4)


def level_hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the digests fall on a level of ``size`` bits; another hash on every level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x ^= words[:, (level + 1) % 4] >> np.uint64(7)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """The bits of every level, for distinct digests."""
    levels, left = [], words
    while len(left):
        size = max(64, 2 * len(left))
        at = level_hash(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slot_of(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each digest, or -1 where no level claims it. Foreign digests may get one."""
    slot, left, before = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = level_hash(words[left], level, len(bits))
        ranks, taken = np.cumsum(bits) - 1 + before, bits[at]
        slot[left[taken]] = ranks[at[taken]]
        left, before = left[~taken], before + int(bits.sum())
    return slot


def build_part(group: pd.DataFrame) -> pd.DataFrame:
    words = words_of(list(group["digest"]))
    levels = build_levels(words)
    place = np.argsort(slot_of(words, levels))
    ordered = group.iloc[place]
    return pd.DataFrame({
        "part": [int(group["part"].iloc[0])],
        "level_bits": [[len(x) for x in levels]],
        "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
        "slots": [b"".join(ordered["digest"])],
        "winners": [[None if pd.isna(x) else int(x) for x in ordered["top_id"]]],
        "sizes": [[int(x) for x in ordered["n"]]],
    })


def look_up(probe: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    slot = np.full(len(probe), -1, dtype=np.int64)
    if len(probe) and len(index):
        row, levels, start = index.iloc[0], [], 0
        for size in row["level_bits"]:
            end = start + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(row["bits"][start:end], dtype=np.uint8), count=int(size)).astype(bool))
            start = end
        words, held = words_of(list(probe["digest"])), np.frombuffer(row["slots"], dtype=">u8").astype(np.uint64).reshape(-1, 4)
        slot = slot_of(words, levels)
        same = (held[np.maximum(slot, 0)] == words).all(axis=1)
        slot[~same] = -1
    return probe.assign(slot=pd.array(slot, dtype="Int64")).assign(slot=lambda x: x["slot"].mask(x["slot"] < 0))[
        ["digest", "part", "slot", "top_id", "n"]
    ]


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a batch with one digest become one, before any shuffle."""
    for batch in batches:
        if len(batch):
            ids = batch["doc_id"].astype("Int64")
            yield batch.assign(doc_id=ids).groupby("digest", as_index=False, sort=False).agg(
                top_id=("doc_id", "max"), n=("digest", "size")
            )


def perfect_index(history: DataFrame, parts: int) -> DataFrame:
    """The index of ``history`` (distinct ``digest``, ``top_id``, ``n``) in so many parts."""
    return history.select("digest", "top_id", "n", part_of(parts)).groupBy("part").applyInPandas(build_part, INDEX)


def classes(rows: DataFrame, historical: Column) -> DataFrame:
    """``digest``, ``keep_id`` and ``group_size`` of every distinct text of ``rows``.

    ``rows`` has ``doc_id`` and ``digest``; ``historical``, a condition on ``doc_id``, says
    which of them the index is made of. The others are looked up in it.
    """
    old = written(
        rows.filter(historical).groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.count("*").alias("n")), "history"
    )
    new = written(
        rows.filter(~historical).mapInPandas(combine, "digest binary, top_id long, n long"), "incoming"
    )
    parts = max(1, -(-max(old.count(), new.count()) // PART))
    index = written(perfect_index(old, parts), "perfect-hash")
    found = written(
        new.select("digest", "top_id", "n", part_of(parts)).groupBy("part")
        .cogroup(index.groupBy("part")).applyInPandas(lambda a, b: look_up(a, b), FOUND), "found"
    )
    held = index.select("part", F.posexplode(F.arrays_zip("winners", "sizes")).alias("slot", "of"), "slots").select(
        "part", F.col("slot").cast("long").alias("slot"), F.expr("substring(slots, slot * 32 + 1, 32)").alias("digest"),
        F.col("of.winners").alias("old_top"), F.col("of.sizes").alias("old_n"),
    )
    members = found.filter("slot is not null").groupBy("part", "slot").agg(F.max("top_id").alias("top_id"), F.sum("n").alias("n"))
    seen = held.join(members, ["part", "slot"], "left").select(
        "digest", F.greatest("old_top", "top_id").alias("keep_id"),
        (F.col("old_n") + F.coalesce("n", F.lit(0))).alias("group_size"),
    )
    fresh = found.filter("slot is null").groupBy("digest").agg(F.max("top_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return seen.unionByName(fresh)


def earlier_half() -> Column:
    """Stands for what an earlier run has seen: a lasting half of the ids. Null ids are new."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))


def exact_duplicates(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """One row per document: who stays of its equals, how many they are, and its digest.

    Null text equals empty text. The largest ``doc_id`` stays; a null id is smaller than any,
    and where all are null one of them stays. Of rows that repeat both id and text exactly
    one is ``kept``. An empty table gives no rows; other columns are not read.
    """
    rows = written(digest_rows(docs), "digests")
    of = written(classes(rows, historical if historical is not None else earlier_half()), "classes")
    pairs = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    return pairs.join(of, "digest").select(
        "doc_id", "keep_id", "group_size", F.explode(F.expr("sequence(1L, copies)")).alias("copy"), "digest"
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each text."""
    rows = written(digest_rows(docs), "digests")
    winners = classes(rows, historical if historical is not None else earlier_half()).select(
        F.col("digest").alias("_digest"), F.coalesce("keep_id", F.lit(0)).alias("_keep"), F.col("keep_id").isNull().alias("_no_id")
    )
    marked = docs.withColumns({
        "_digest": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)),
        "_keep": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_no_id": F.col("doc_id").isNull(),
    })
    keys = ["_digest", "_keep", "_no_id"]
    once = F.row_number().over(_within(keys))
    return marked.join(winners, keys).withColumn("_copy", once).filter("_copy = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def _within(keys: list[str]):
    """Inside the join's own partitions and order: repeated rows of one id and text."""
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*keys)
