"""Language identification by held-out accuracy, and neighbours by recall against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablerelay.llm import language_id, neighbours

WORDS = {
    "en": "the and of with house water never other small green because under between".split(),
    "de": "der und nicht mit haus wasser niemals andere klein grün weil unter zwischen".split(),
    "fr": "le et ne avec maison eau jamais autre petit vert parce sous entre".split(),
}


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 80)))
        rows.append((k, text.upper() if k % 9 == 0 else text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(prose):
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(prose.filter(~out))
    assert set(model) == set(WORDS) and all(len(x) <= language_id.DICTIONARY for x in model.values())
    told = language_id.identified(prose.filter(out), model).collect()
    assert len(told) > 30
    assert sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert sum(r.rejected for r in told) <= 0.03 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def test_every_label_is_learned_and_told(spark):
    """Seventy languages, each of words of its own."""
    rng = random.Random(8)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(12)] for k in range(70)}
    rows = [(40 * k + n, " ".join(rng.choice(own) for _ in range(40)), lang) for k, (lang, own) in enumerate(words.items()) for n in range(12 if k < 65 else 6)]
    rows += [(None, f"shared id {k}", "one") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~out))
    assert set(model) == {*words, "one"}
    told = language_id.identified(docs.filter(out & (F.col("lang") != "one")), model).collect()
    assert len({r.lang for r in told}) > 64 and all(r.lang == r.lang_pred for r in told)


def test_learning_and_telling_are_the_same_in_any_order(prose):
    assert language_id.learn(prose) == language_id.learn(prose.repartition(7))


def test_odd_texts_have_a_defined_language(odd_docs, no_docs, prose):
    model = language_id.learn(prose)
    told = {(r.doc_id, r.text): r for r in language_id.identified(odd_docs.withColumn("score", F.lit("mine")), model).collect()}
    assert len(told) == len({(r.doc_id, r.text) for r in odd_docs.collect()})
    for (_, text), r in told.items():
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model
    assert language_id.identified(no_docs, model).collect() == []
    assert language_id.learn(no_docs) == {}
    assert {r.lang_pred for r in language_id.identified(odd_docs, {}).collect()} == {"und"}
    assert {(r.score) for r in language_id.identified(prose, {"en": model["en"]}).collect()} == {1.0}


def test_one_id_that_many_rows_share_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DOCUMENTS", 5)
    rows = spark.range(400).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert len(language_id.learn(rows).get("en", b"")) <= language_id.DICTIONARY


def brute(vectors, k=5):
    """Nearest of the queries among all usable rows, by id, in plain numpy."""
    fine = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(i, []).append(np.array(v, dtype=np.float64))
    out = set()
    for i in sorted(fine):
        if i % 50:
            continue
        best = {}
        for j in fine:
            if j != i:
                scores = [(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) for a in fine[i] for b in fine[j] if len(a) == len(b)]
                if scores:
                    best[j] = max(scores)
        for rank, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], start=1):
            out.add((i, rank, j, round(float(s), 12)))
    return out


def found(df):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect()}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=64)], 0) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, true = found(neighbours.nearest(df, F.col("vec_id") % 50 == 0)), brute([r[:2] for r in rows])
    assert len(got) == len(true) == 300
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in true}
    assert len(hits) >= 0.9 * 300


def test_ties_odd_vectors_and_repeated_ids(spark):
    """With every bucket of every table probed, the result is that of brute force."""
    rng = np.random.default_rng(5)
    plain = [(k, [float(x) for x in rng.integers(-3, 4, size=6)], 0) for k in range(1, 160)]
    same = [(1000 + k, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], 0) for k in range(200)]
    odd = [(2000, None, 0), (2050, [0.0] * 6, 0), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2150, [float("nan")] * 6, 0), (2200, [float("inf")] + [0.0] * 5, 0),
           (None, [1.0] * 6, 0), (50, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (3000, [1.0, 1.0], 0), (3001, [2.0, 1.0], None), (3050, [], 0), (1001, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], 0)]
    rows = plain + same + odd
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("code", F.lit(1))
    got = found(neighbours.nearest(df, F.col("vec_id") % 50 == 0, probes=16))
    assert got == brute([r[:2] for r in rows])


def test_few_or_no_vectors_give_all_there_are(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [-1.0, 0.1], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    got = found(neighbours.nearest(few, F.col("vec_id") % 50 == 0, tables=1, probes=1))
    assert {(q, r, v) for q, r, v, _ in got} == {(0, 1, 2), (0, 2, 1)}
    assert neighbours.nearest(few.filter("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_hot_buckets_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_CANDIDATES", 20)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 3)
    rows = [(k, [1.0, 0.5, 0.25, float(k % 3)], 0) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(neighbours.nearest(df, F.col("vec_id") % 50 == 0)) == brute([r[:2] for r in rows])


def test_the_transform_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(20, 48))
    y = neighbours.turned(x, 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(y @ y.T, unit @ unit.T)


def plain_prediction(text, dictionaries):
    """The method with a fresh compressor for every piece of text and every dictionary."""
    import re

    import zstandard

    def size(content, piece):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            6, source_size=2048, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        data.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(piece))

    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in words) or not dictionaries:
        return "und", 0.0, True
    pieces = [words[k:k + 2048].encode() for k in range(0, len(words), 2048)]
    sums = {lang: sum(size(d, p) for p in pieces) for lang, d in dictionaries.items()}

    def best(of):
        order = sorted(of, key=lambda lang: of[lang])
        return order[0], (of[order[1]] - of[order[0]]) / of[order[1]] if len(order) > 1 else 1.0

    lang, score = best(sums)
    if score < 0.002:
        for name, d in dictionaries.items():
            for k in range(8):
                part = d[k * len(d) // 8:(k + 1) * len(d) // 8] or b" "
                sums[name] += sum(size(part, p) for p in pieces)
        lang, score = best(sums)
    return lang, score, score < 0.002


def test_predictions_equal_plain_compression(prose, odd_docs):
    model = language_id.learn(prose.filter(~language_id.held_out(F.col("doc_id"))))
    docs = prose.unionByName(odd_docs.select("doc_id", "text", "lang"))
    for r in language_id.identified(docs, model).collect():
        assert (r.lang_pred, r.score, r.rejected) == plain_prediction(r.text, model), r.text and r.text[:80]
