"""SimHash components and byte-level BPE, against brute force and the public library."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tablerelay.llm import byte_bpe, simhash
from tablerelay.llm.common import components
from tests.llm.conftest import rows_of, sentence

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest index reachable over at most four differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(odd_docs):
    docs = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_components(fps)
    least = {g: min((docs[i].doc_id for i in range(len(docs)) if groups[i] == g and docs[i].doc_id is not None), default=None) for g in groups}
    wanted = sorted(((r.doc_id, f"{fp:016x}", least[g]) for r, fp, g in zip(docs, fps, groups)), key=repr)
    assert rows_of(simhash.near_duplicates(odd_docs), "doc_id", "fingerprint", "component_id") == wanted


def test_long_texts_are_cut_into_segments_without_a_trace(monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, n) for n in (0, 1, 2, 3, 4, 5, 7, 40, 400)] + ["x" * 100, " a  b\tc \n d\x0be ", "A É ß K"]
    plain = [simhash.fingerprint(t) for t in texts]
    assert plain == [plain_fingerprint(t) for t in texts]
    for size in (1, 5, 17):
        monkeypatch.setattr(simhash, "_SEGMENT", size)
        assert [simhash.fingerprint(t) for t in texts] == plain


def test_masks_leave_every_four_bits_together_in_a_table():
    rng = random.Random(5)
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flipped & (m % 2**64) == 0 for m in simhash.masks())


@pytest.mark.parametrize("largest", [simhash.LARGEST, 8])
def test_links_connect_what_brute_force_connects(spark, largest):
    """Balls of fingerprints: with a small ``largest`` their buckets go by neighbours."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), largest)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    found = {r.node: r.component for r in components(links, "a", "b", "test").collect()}
    wanted = plain_components(fps)
    groups = [found.get(x, x) for x in signed]
    assert len(set(zip(groups, wanted))) == len(set(groups)) == len(set(wanted))
    if largest != 8:
        assert all(a != b for a, b in pairs)


def test_groups_that_run_over_batches_are_whole():
    rng = random.Random(2)
    rows = sorted((t, k, rng.getrandbits(3)) for t in range(3) for k in range(20) for _ in range(rng.choice([1, 2, 3, 30])))
    frame = pd.DataFrame(rows, columns=["table", "key", "fp"]).drop_duplicates()
    whole = pd.concat(simhash.bucket_links(iter([frame])))
    for size in (1, 3, 7):
        parts = pd.concat(simhash.bucket_links(frame.iloc[i:i + size] for i in range(0, len(frame), size)))
        assert set(map(tuple, parts.to_numpy().tolist())) == set(map(tuple, whole.to_numpy().tolist()))
    crowd = pd.concat(simhash.bucket_links((frame.iloc[i:i + 5] for i in range(0, len(frame), 5)), largest=2))
    sizes = frame.groupby(["table", "key"])["fp"].transform("size")
    assert set(crowd[crowd["b"].isna()]["a"]) == set(frame[sizes > 2]["fp"])


def test_chains_and_stars_settle(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1500).select(F.lit(5000).alias("a"), F.col("id").alias("b"))
    found = components(chain.unionByName(star), "a", "b", "test").groupBy("component").count()
    assert rows_of(found, "component", "count") == [(0, 201), (1000, 501)]


def test_dropping_keeps_one_of_each_component(odd_docs, no_docs):
    out = simhash.drop_near_duplicates(odd_docs.withColumn("fingerprint", F.lit(1)).withColumn("component", F.lit(1)))
    groups = plain_components([plain_fingerprint(r.text) for r in odd_docs.collect()])
    assert out.count() == len(set(groups))
    assert out.columns == [*odd_docs.columns, "fingerprint", "component"]
    assert simhash.drop_near_duplicates(no_docs).collect() == []
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_equal_the_library(odd_docs, no_docs, library):
    out = byte_bpe.encode_documents(odd_docs.withColumn("n_tokens", F.lit("mine")), RANKS, public_tokenizers.PATTERN, ids=True)
    for r in out.collect():
        ids = library.encode_ordinary(r.text or "")
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    decoded = byte_bpe.decode_documents(out.select("text", "token_ids"), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded.collect())
    assert byte_bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_ids_of_long_pieces_and_every_kind_of_character(library, monkeypatch):
    rng = random.Random(1)
    by = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    letters = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x200B, 0x3000, 0xE9, 0x4E2D, 0x1F600, 0x301)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 5000, " " * 5000, "é" * 3000, *("".join(rng.choice("etaoin") for _ in range(n)) for n in (2047, 2048, 2049, 6000)), "<|endoftext|>"]
    for at_once, longest in ((200_000, 2048), (7, 16)):
        monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
        monkeypatch.setattr(byte_bpe, "LONGEST", longest)
        monkeypatch.setattr(byte_bpe, "REMEMBERED", 500)
        by.known.clear()
        found = [[] for _ in texts]
        for k, ids in by.encode_many(texts):
            found[k] += ids
        assert found == [library.encode_ordinary(t) for t in texts]
