"""Exact deduplication and mixing, against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablerelay.llm import exact, mixing
from tests.llm.conftest import rows_of


def expected_classes(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        kept = False
        for x in ids:
            stays = x == keep and not kept
            kept |= stays
            out.append((x, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("historical", [None, "true", "false", "doc_id > 5"])
def test_exact_duplicates_whatever_was_seen_before(odd_docs, historical):
    if historical is not None:
        historical = F.coalesce(F.expr(historical), F.lit(False))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(exact.exact_duplicates(odd_docs, historical), *COLUMNS) == expected_classes(docs)


def test_exact_duplicates_of_nothing(no_docs):
    assert exact.exact_duplicates(no_docs).collect() == []
    assert exact.drop_exact_duplicates(no_docs).collect() == []


def test_dropping_keeps_one_whole_row_a_text(odd_docs):
    left = exact.drop_exact_duplicates(odd_docs.withColumn("digest", F.lit("mine")).withColumn("part", F.lit(1)))
    assert left.columns == [*odd_docs.columns, "digest", "part"]
    texts = Counter(r.text or "" for r in left.collect())
    assert set(texts.values()) == {1}
    assert set(texts) == {r.text or "" for r in odd_docs.collect()}
    assert {r.doc_id for r in left.collect() if r.text and r.text.startswith("same id")} == {10}


def test_perfect_hash_is_minimal_and_refuses_foreign_digests():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    words = exact.words_of(digests)
    levels = exact.build_levels(words)
    assert sorted(exact.slot_of(words, levels).tolist()) == list(range(5000))
    import pandas as pd

    group = pd.DataFrame({"part": 0, "digest": digests, "top_id": range(5000), "n": 1})
    index = exact.build_part(group)
    foreign = [hashlib.sha256(f"x{k}".encode()).digest() for k in range(5000)]
    probe = pd.DataFrame({"digest": digests[:10] + foreign, "part": 0, "top_id": 0, "n": 1})
    found = exact.look_up(probe, index)
    assert found["slot"].notna().tolist() == [True] * 10 + [False] * 5000


def words_in(text):
    return len((text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")) - (text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ").count("")


def test_mixing_comes_near_its_targets(odd_docs):
    out = [r.asDict() for r in mixing.mix_sizes(odd_docs).collect()]
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r.source] += words_in(r.text)
    assert len(out) == odd_docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights, share = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values())
    held, free = {}, set(names)
    while True:
        level = (share - sum(held.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        held |= {s: 2 * sizes[s] for s in over}
        free -= over
    by_size = {(r["source_size"], round(r["target"], 6)) for r in out}
    assert by_size == {(sizes[s], round(float(held.get(s, weights[s] * level)), 6)) for s in names}
    of = mixing.mix(odd_docs)
    taken = {(r.no_source, r.source_key): r.w for r in of.pieces.groupBy(*mixing.KEY).agg(F.sum("words").alias("w")).collect()}
    for s in names:
        target = held.get(s, weights[s] * level)
        assert abs(taken.get((s is None, s or ""), 0) - target) <= max(4 * of.block, 0.01 * target)


def test_mixing_agrees_with_itself_and_takes_nothing_of_nothing(odd_docs, no_docs):
    first, second = (rows_of(mixing.mix_sizes(d), "doc_id", "size", "taken") for d in (odd_docs, odd_docs.repartition(7)))
    assert first == second
    assert mixing.mix_sizes(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []


def test_mixed_documents_have_the_words_taken(odd_docs):
    sizes = mixing.mix_sizes(odd_docs)
    mixed = mixing.mixed_documents(odd_docs.withColumn("pass", F.lit(1)).withColumn("block", F.lit("b")))
    assert mixed.columns == [*odd_docs.columns, "pass", "block"]
    assert sum(words_in(r.text) for r in mixed.collect()) == sizes.agg(F.sum("taken")).first()[0]
    whole = {(r.doc_id, r.text) for r in odd_docs.collect()}
    cut = [r for r in mixed.collect() if (r.doc_id, r.text) not in whole]
    assert len(cut) <= 2 * odd_docs.select("source").distinct().count()


def test_a_cut_document_is_an_unchanged_prefix(spark):
    # The third source's target is one and a half times its words, so its second pass is cut.
    text = {s: "\n\t" + "".join(f"é{k}\n    w\t\t" for k in range(n)) for s, n in (("a", 300), ("b", 300), ("c", 100))}
    docs = spark.createDataFrame([(k, text[s], s) for k, s in enumerate("abc")], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs).collect()
    assert all(text[r.source].startswith(r.text) for r in mixed)
    cut = [r for r in mixed if r.text != text[r.source]]
    assert cut and all(not r.text[-1].isspace() for r in cut)
    assert sum(words_in(r.text) for r in mixed) == mixing.mix_sizes(docs).agg(F.sum("taken")).first()[0]


def test_ranks_of_a_source_have_no_gaps(spark):
    targets = spark.createDataFrame([(False, "a", 900, 5, 700.0), (False, "b", 50, 2, 100.0), (True, "", 10, 1, 0.0)], "no_source boolean, source_key string, source_size long, weight int, target double")
    slots = mixing.schedule(spark, targets, 8000).toPandas()
    assert sorted(slots["slot"]) == list(range(8000))
    for name, share in (("a", 0.875), ("b", 0.125)):
        own = slots[slots["source_key"] == name].sort_values("slot")
        assert own["block"].tolist() == list(range(len(own)))
        early = np.searchsorted(own["slot"].to_numpy(), np.arange(1, 8001))  # every stretch from the start is near its share
        assert np.abs(early - share * np.arange(1, 8001)).max() < 8


def test_every_source_has_its_target_whatever_its_size(spark):
    """Sources of a few words beside one of millions."""
    rows = [(k, "w " * 20_000, "big") for k in range(400)]
    sizes = {"s01": 1, "s02": 2, "s03": 10, "s04": 10, "s05": 300, "s06": 1000, "s07": 2000, "s08": 10_000}
    for k, (name, n) in enumerate(sizes.items()):
        rows += [(1000 + 10 * k, "v " * (n // 2), name), (1001 + 10 * k, "v " * (n - n // 2), name)]
    rows += [(None, f"null {k} id", None) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    out = mixing.mix_sizes(docs)
    totals = docs.groupBy("source").count().count()
    found = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum(F.when(F.col("taken") > 0, F.col("slot").isNull().cast("int"))).alias("lost")).collect()
    assert sum(1 for r in found) >= totals - 1  # two sources have the same figures
    for r in found:
        times = 2 if r.source_size == 10 else 1
        assert r.taken == times * round(r.target) and r.target > 0 and not r.lost
    assert all(0 <= r.taken <= 2 * r.size for r in out.collect())
    kept = mixing.mixed_documents(docs).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert len(kept) == totals
    # The order by slots mixes: the large source's documents are spread over the whole of it.
    slots = sorted(r.slot for r in out.filter("size = 20000 and taken > 0").collect())
    assert len(set(slots)) == len(slots) and max(b - a for a, b in zip(slots, slots[1:])) < 3 * (slots[-1] / len(slots))
