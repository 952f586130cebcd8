"""Aligning two tokenizers over a corpus, each distinct text once.

Rows are grouped by their whole text first, so copies cost nothing but their number. Each
distinct text is encoded by both tokenizers and cut where tokens of both end; the tokens of a
cut are linked. How many documents hold a link is counted over distinct texts, weighted by
their number of rows, and the measures go back to the rows by the texts' digests.

A text's links meet the counts of the whole corpus by part: some megabytes of texts ask for
each of their links once. So a link that is in nearly every text is shuffled once a part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.llm.common import PIECE, _slices, quoted, written

#: Pairs of token places that are worked out at a time; cuts with more go by distinct ids.
PAIRS = 100_000
#: A link is one number: the A id times this, plus the B id. Ids are below it.
IDS = 1 << 31

MEASURED = (
    "digest binary, n long, part long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<long>, times array<long>"
)


#: Fixed value: how byte-level vocabularies split a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters of a text up to which the faster encoder of A is used; it can't take very long runs.
QUICK = 100_000


class Pair:
    """Two tokenizers: their ids of a text, and the bytes that each id stands for."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # Every id as it is written, before another of its side and at the end of its side of a cut.
        self.say = [f"{k}{mark}" for size, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for k in range(size) for mark in marks]
        self.quick = self._ranked(json.load(open(a_path, encoding="utf-8")), letters)

    def _ranked(self, told: dict, letters: dict[str, int]):
        """The same vocabulary for the tiktoken library, which needs a third of the time, where it
        is plain: split by SPLIT, merges in the order of ids. None where it isn't."""
        import tiktoken

        model, before = told["model"], told["pre_tokenizer"] or {}
        special = {x["content"] for x in told["added_tokens"]}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if not plain or told["normalizer"] or before.get("add_prefix_space") or model.get("ignore_merges"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(b <= a for a, b in zip(merged, merged[1:])):
            return None
        ranks = {bytes(letters[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a space and the text, and of B, which puts the space there itself."""
        return [self._encode_a(" " + t) for t in texts], self.b.encode(texts, num_threads=1)

    def _encode_a(self, text: str) -> list[int]:
        if self.quick is not None and len(text) <= QUICK:
            return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be
    seen, the others from code point 256 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def linked(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links of a text and how often each occurs, from ids and their cuts."""
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_start, b_start = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    many = in_a * in_b
    keys, counts = [], []
    small = np.flatnonzero(many <= PAIRS)
    runs = np.cumsum(many[small]) // PAIRS
    for some in np.split(small, np.flatnonzero(np.diff(runs)) + 1):
        # Every A token of these cuts, beside as many B tokens as its cut has.
        left = np.repeat(a_start[some], in_a[some]) + _counted(in_a[some])
        width, base = np.repeat(in_b[some], in_a[some]), np.repeat(b_start[some], in_a[some])
        key, n = np.unique(np.repeat(a[left], width) * IDS + b[np.repeat(base, width) + _counted(width)], return_counts=True)
        keys.append(key)
        counts.append(n)
    for g in np.flatnonzero(many > PAIRS).tolist():
        a_ids, a_n = np.unique(a[a_start[g]:a_start[g] + in_a[g]], return_counts=True)
        b_ids, b_n = np.unique(b[b_start[g]:b_start[g] + in_b[g]], return_counts=True)
        for k, n in zip(a_ids.tolist(), a_n.tolist()):
            keys.append(k * IDS + b_ids)
            counts.append(n * b_n)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return key, total


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each length, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def told(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int, pair: Pair) -> str:
    """The digest of all cuts: decimal ids, with ``|`` within a cut and ``;`` between cuts."""
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    a_last[np.cumsum(in_a) - 1] = 1
    b_last[np.cumsum(in_b) - 1] = 1
    said = np.empty(len(a) + len(b), dtype=np.int64)
    said[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = 2 * a + a_last
    said[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = 2 * (b + len(pair.a_bytes)) + b_last
    return hashlib.sha256("".join(map(pair.say.__getitem__, said.tolist()))[:-1].encode()).hexdigest()


NOTHING = (0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def aligned(text: str, a_ids: list[int], b_ids: list[int], pair: Pair) -> tuple:
    """``n_a, n_b, n_groups, n_links, groups_sha256, links, times`` of one text."""
    whole = (" " + text).encode()
    if not text or any(b"".join(map(of.__getitem__, ids)) != whole for of, ids in ((pair.a_bytes, a_ids), (pair.b_bytes, b_ids))):
        return NOTHING
    a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    links, times = linked(a, b, a_group, b_group, len(cuts))
    return len(a), len(b), len(cuts), int(times.sum()), told(a, b, a_group, b_group, len(cuts), pair), links, times


def align_texts(a_path: str, b_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        held = 0
        for batch in batches:
            for piece in _slices(batch, 0, PIECE // 4):
                texts = piece.column(0).to_pylist()
                a, b = pair.encode(texts)
                rows = [aligned(t, x, y, pair) for t, x, y in zip(texts, a, b)]
                held += sum(map(len, texts))
                # A part ends with the slice that fills it.
                yield _measured(piece, chunk, rows)
                if held >= PIECE:
                    chunk, held = chunk + 1, 0

    return run


def _measured(piece: pa.RecordBatch, part: int, rows: list[tuple]) -> pa.RecordBatch:
    numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]), pa.int64())) for k in (5, 6)]
    parts = pa.array([part] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [piece.column(1), piece.column(2), parts, *numbers, pa.array([r[4] for r in rows], pa.string()), *lists],
        names=["digest", "n", "part", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"],
    )


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each text that is not empty, with its digest and its number of rows."""
    column = F.col(quoted(text)).cast("string")
    texts = docs.select(column.alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return texts.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "n")


def link_counts(measured: DataFrame) -> DataFrame:
    """Every link of the corpus, the number of documents that hold it, and whether no other
    link of its A id is held by more. An A id has at most as many links as B has ids."""
    each = measured.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("documents"))
    each = each.withColumn("a_id", F.shiftright("link", 31))
    most = each.groupBy("a_id").agg(F.max("documents").alias("most"))
    return each.join(most, "a_id").select("link", "documents", (F.col("documents") == F.col("most")).alias("best"))


def weigh(part: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of a part's texts, from the counts of all its links."""
    link = counts["link"].to_numpy()
    order = np.argsort(link)
    link, documents, best = link[order], counts["documents"].to_numpy()[order], counts["best"].to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for links, times in zip(texts["links"], texts["times"]):
        at, times = np.searchsorted(link, links.values.to_numpy()), times.values.to_numpy()
        n_best.append(int(times[best[at]].sum()) if len(at) else 0)
        count_sum.append(int((times * documents[at]).sum()) if len(at) else 0)
    return pa.table({"digest": texts["digest"], "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, a_path: str, b_path: str, row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Measures of every row, and the links of the corpus with their numbers of documents.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece
    model; workers read both, so they must be installed there. Every row counts as a document,
    repeated ids too. Null and empty texts, and those that a tokenizer does not give back byte
    for byte, have no tokens: zeros and an empty digest. An empty table gives no rows; other
    columns are not read.
    """
    given = docs.select(F.col(quoted(row_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    measured = written(distinct_texts(given).mapInArrow(align_texts(a_path, b_path), MEASURED), "aligned")
    counts = written(link_counts(measured), "link-counts")
    asked = measured.select(F.col("part").alias("asking"), F.explode("links").alias("link")).distinct()
    answers = asked.join(counts, "link")
    weighed = (
        measured.filter("n_links > 0").select("digest", "part", "links", "times").groupBy("part")
        .cogroup(answers.groupBy("asking")).applyInArrow(weigh, "digest binary, n_best long, count_sum long")
    )
    whole = measured.select("digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(weighed, "digest", "left")
    rows = given.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).join(whole, "digest", "left")
    measures = rows.select(
        "doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
    return measures, counts
