"""Byte-level BPE by a file of ranks, encoding and decoding, with numpy matrices.

A text is split by the pattern, and every piece not seen before becomes a row of byte tokens in
a padded matrix of rows of like length. Each round looks up the ranks of the adjacent pairs
that changed in a hash table of pairs, merges in every row the leftmost pair of least rank,
and closes the gap; rows that have no pair left leave the matrix. Pieces too long for a
matrix (LONGEST bytes) merge in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablerelay.llm.common import add_columns

#: Bytes of a piece up to which it goes into a matrix.
LONGEST = 2048
#: Pieces remembered by a task, and pieces held before new ones are encoded together.
REMEMBERED, AT_ONCE = 300_000, 200_000
#: The rank of no pair.
NONE = np.int32(2**31 - 1)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    """The ranks of a file, as a hash table of pairs; ids are ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in open(path, "rb") if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(k).encode() for k in range(len(self.bytes_of))]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self._make_table()

    def _make_table(self) -> None:
        """Every way to put a token together from two, by open addressing in two arrays."""
        pairs = [
            (left, right, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
            if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None
        ]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 3
        size = 1 << max(4, (4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        key, at = left << 32 | right, self._home(left << 32 | right)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]  # of those that want one place the last gets it
            won = self.keys[at] == key
            self.values[at[won]] = rank[won]
            key, rank, at = key[~won], rank[~won], at[~won] + 1 & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to; NONE where either is padding or they don't merge."""
        shape, key = left.shape, (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out, todo = np.full(len(key), NONE, dtype=np.int32), np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        at = self._home(key[todo])
        while len(todo):
            held = self.keys[at]
            same = held == key[todo]
            out[todo[same]] = self.values[at[same]]
            on = ~same & (held != -1)
            todo, at = todo[on], at[on] + 1 & self.mask
        return out.reshape(shape)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. A piece that is a token is that token."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = (whole,)
            elif len(piece) > LONGEST:
                out[k] = self._merge_long(piece)
            else:
                by_length.setdefault((len(piece) - 1).bit_length(), []).append(k)
        for some in by_length.values():
            width = max(len(pieces[k]) for k in some)
            step = max(1, 4_000_000 // width)
            for i in range(0, len(some), step):
                rows = some[i:i + step]
                for k, ids in zip(rows, self._merge_matrix([pieces[k] for k in rows], width)):
                    out[k] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces])
        tokens = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        tokens[:, :width] = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        ranks = np.full((len(pieces), width + 1), NONE, dtype=np.int32)  # of a token and the next
        ranks[:, :width] = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
        row, out = np.arange(len(pieces)), [()] * len(pieces)
        while len(row):
            at = ranks.argmin(axis=1)
            every = np.arange(len(row))
            least = ranks[every, at]
            done = least == NONE
            if done.any():
                for k, ids, n in zip(row[done], tokens[done], length[done]):
                    out[k] = tuple(ids[:n].tolist())
                go = ~done
                row, tokens, ranks, at, least, length = row[go], tokens[go], ranks[go], at[go], least[go], length[go]
                every = np.arange(len(row))
                if not len(row):
                    break
                tokens, ranks = tokens[:, : length.max() + 1], ranks[:, : length.max() + 1]
            columns = np.arange(tokens.shape[1])[None, :]
            after = np.minimum(columns + (columns > at[:, None]), tokens.shape[1] - 1)  # closes the gap behind the merged pair
            tokens, ranks = np.take_along_axis(tokens, after, 1), np.take_along_axis(ranks, after, 1)
            tokens[every, at] = least
            tokens[:, -1], ranks[:, -1] = -1, NONE
            length = length - 1
            ranks[every, at] = self.pair_ranks(least, tokens[every, np.minimum(at + 1, tokens.shape[1] - 1)])
            before = np.maximum(at - 1, 0)
            ranks[every, before] = np.where(at > 0, self.pair_ranks(tokens[every, before], least), ranks[every, before])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

        def rank(i: int) -> int | None:
            j = after[i]
            return self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return tuple(x for x, living in zip(ids, alive) if living)

    def encode_pieces(self, pieces: Iterable[str]) -> None:
        """Remember the ids of pieces not met before."""
        new = [p for p in set(pieces) if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set(pieces))
        self.known.update(zip(new, self.merge([p.encode() for p in new])))

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(which text, some ids of it) in order, a long text in several steps."""
        held: list[tuple[int, list[str]]] = []
        n = 0
        for k, text in enumerate(texts):
            found = (m.group() for m in self.pattern.finditer(text)) if len(text or "") > 1_000_000 else iter(self.pattern.findall(text or ""))
            while pieces := list(islice(found, AT_ONCE)):
                held.append((k, pieces))
                n += len(pieces)
                if n >= AT_ONCE:
                    yield from self._flush(held)
                    held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        self.encode_pieces(list(chain.from_iterable(pieces for _, pieces in held)))
        for k, pieces in held:
            yield k, list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: bool = False) -> DataFrame:
    """``docs`` with the number of tokens of each whole text and two digests: of the ids in
    decimal with single spaces, and of the bytes that the ids decode to. ``ids=True`` adds
    them as ``token_ids``.

    Null and empty texts have no ids and the digests of nothing. Nothing in a text stands for
    a special token. Rows that repeat stay; existing columns with these names are replaced.
    ``path`` is read by every worker and must be installed there.
    """
    schema = T.StructType([*ENCODED.fields, IDS] if ids else ENCODED.fields)

    def make():
        by = encoder(path, pattern)

        def work(texts):
            counts, told, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            parts: list[np.ndarray] = []
            for k, some in by.encode_many(texts):
                told[k].update((b" " if counts[k] else b"") + b" ".join(map(by.decimal.__getitem__, some)))
                decoded[k].update(by.decode(some))
                counts[k] += len(some)
                if ids:
                    parts.append(np.array(some, dtype=np.int32))
            columns = [pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in told]), pa.array([x.hexdigest() for x in decoded])]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                values = pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32))
                kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), values, type=kind))
            return columns

        return work

    return add_columns(docs, text, schema, make)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (with ``token_ids``) with ``decoded``, the bytes that the ids stand for."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
            added = pa.array([None if x is None else by.decode(x) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(decoded, schema)
