"""Line deduplication, tokenizer alignment and the Merkle manifest, against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablerelay.llm import alignment, lines, merkle
from tests.llm.conftest import DOCS, rows_of

SPACE = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def expected_lines(docs):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 10:
                holders[key].add((doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in docs:
        all_lines = (text or "").split("\n")
        stay = []
        for line in all_lines:
            ids = holders[line.strip(SPACE).translate(LOWER)]
            if len(ids) < 2 or (doc_id is None, doc_id or 0) == min(ids):
                stay.append(line)
        out.append((doc_id, "\n".join(stay), len(all_lines), len(all_lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_docs(spark):
    rng = random.Random(3)
    pool = [f"Shared line {k} of several documents" for k in range(30)] + ["short", "", "  ", "ÄÖÜ漢字\U0001f600abcd", "ÄÖÜ漢字\U0001f600abc"]
    rows = [
        (1, "Every line goes elsewhere"), (2, "every LINE goes elsewhere"), (3, "\tevery line goes elsewhere \r\nEvery line goes elsewhere"),
        (4, "within one twice\nwithin one twice"), (4, "same id, a line of two rows"), (4, "same id, a line of two rows"),
        (5, None), (6, ""), (7, "\n\n"), (None, "a line of no one at all\nevery line goes elsewhere"), (None, "a line of no one at all"),
        (8, "x" * 300_000 + "\nEvery line goes elsewhere\n" + "y" * 12), (9, "\x1c not white space \x1c"), (10, "\x1c not white space \x1c\x0b"),
        (11, "EXACTLY TEN"[:10]), (12, "exactly te"), (13, "nine char"), (14, "nine char"),
        *((100 + k % 150, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(200)),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("log_bits", [6, lines.LOG_BITS])
def test_lines_whatever_the_filters_hold(line_docs, log_bits):
    found = lines.deduplicated_lines(line_docs.withColumn("digest", F.lit("mine")), log_bits=log_bits)
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == expected_lines([(r.doc_id, r.text) for r in line_docs.collect()])


def test_lines_of_odd_documents_and_of_none(odd_docs, no_docs):
    found = lines.deduplicated_lines(odd_docs.withColumn("gone", F.lit(1)))
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == expected_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lines.deduplicated_lines(no_docs).collect() == []


def test_filters_lose_no_repeat_and_suspect_few(spark):
    rows = [(k, f"a line that only document {k} has\nand a line of {k // 2} and its neighbour") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pages = lines.seen_twice(docs)
    shared = spark.sparkContext.broadcast(("test", lines.LOG_BITS, pages))
    bits = lines.Filter.of(shared)
    found = [lines.suspected(lines.keys_of(text), bits, lines.LOG_BITS) for _, text in rows]
    assert all(f"and a line of {k // 2} and its neighbour".encode() in x for k, x in enumerate(found))
    assert sum(map(len, found)) < 4010


A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def expected_alignment(docs):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    shown = {v: k for k, v in alignment.byte_letters().items()}
    a_token = {k: t for t, k in a.get_vocab().items()}

    def cuts(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        bytes_a = [bytes(alignment.byte_letters()[c] for c in a_token[k]) for k in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        out, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                left.append(ids_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                right.append(ids_b[j])
                j += 1
            if at_a == at_b and left and right:
                out.append((left, right))
                left, right = [], []
        return out

    assert shown[32] == "Ġ"
    all_cuts = [(doc_id, cuts(text)) for doc_id, text in docs]
    counts = Counter(link for _, found in all_cuts for link in {(x, y) for left, right in found for x in left for y in right})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found in all_cuts:
        links = [(x, y) for left, right in found for x in left for y in right]
        say = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in found)
        out.append((
            doc_id, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links),
            sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(say.encode()).hexdigest() if found else "",
        ))
    return sorted(out, key=repr)


MEASURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, odd_docs):
    odd = ["<|endoftext|> and <s> </s> <unk>", "a\x00b", "ﬁ ½ ①", "  two  spaces ", "\n\n\ttabs\r\n", "漢字かな交じり文です", "\U0001f600\U0001f468‍\U0001f469", "é é",
           "▁ low line", "<0x41> text", "x" * 5000, "٣٤٥ עברית", "same copy", "same copy", "same copy"]
    extra = spark.createDataFrame([(1000 + k, t, None, None, None) for k, t in enumerate(odd)], DOCS)
    docs = odd_docs.unionByName(extra).repartition(5)
    measures, counts = alignment.align(docs.withColumn("links", F.lit(1)).withColumn("n", F.lit("n")), A_PATH, B_PATH)
    assert rows_of(measures, *MEASURES) == expected_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert counts.filter("documents >= 3").count() > 0


def test_alignment_of_nothing(no_docs):
    measures, counts = alignment.align(no_docs, A_PATH, B_PATH)
    assert measures.collect() == [] and counts.collect() == []


def test_links_of_small_and_of_huge_cuts():
    rng = np.random.default_rng(1)
    a_group = np.sort(np.concatenate([rng.integers(0, 50, 300), np.full(900, 20), np.arange(50)]))
    b_group = np.sort(np.concatenate([rng.integers(0, 50, 300), np.full(800, 20), np.arange(50)]))
    a, b = rng.integers(0, 40, len(a_group)), rng.integers(0, 40, len(b_group))
    want = Counter((x * alignment.IDS + y).item() for g in range(50) for x in a[a_group == g] for y in b[b_group == g])
    keys, counts = alignment.linked(a.astype(np.int64), b.astype(np.int64), a_group, b_group, 50)
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def way_of(levels, at):
    for nodes in levels[:-1]:
        first = at // 8 * 8
        yield nodes[first:at], nodes[at + 1:first + 8]
        at //= 8


def expected_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels_of([x[2] for x in sorted(groups[name], key=lambda x: x[:3])]) for name in names}
    over = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            way = [*way_of(trees[name], at), *way_of(over, k)]
            x = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                x = leaf_of((*row[:4], row[4].translate(LOWER)))
            for before, after in way:
                x = H(*before, x, *after)
            proof = H(*(d for before, after in way for d in [*before, *after]))
            out.append((row[0], leaf, trees[name][-1][0], over[-1][0], proof, x, x == over[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def listed(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_manifest_of_odd_documents(odd_docs, no_docs):
    assert rows_of(merkle.manifest(odd_docs.withColumn("pos", F.lit(1)).withColumn("tree", F.lit(""))), *COLUMNS) == expected_manifest(listed(odd_docs))
    assert merkle.manifest(no_docs).collect() == []
    one = odd_docs.filter("doc_id = 4")
    assert rows_of(merkle.manifest(one), *COLUMNS) == expected_manifest(listed(one))


@pytest.mark.parametrize("n", [9, 4096, 9001])
def test_manifest_over_several_blocks(spark, n):
    rows = [(k * 7 % 10_007, f"Text {k}", "en" if k % 50 else f"l{k % 19}", "s", k) for k in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert rows_of(merkle.manifest(docs), *COLUMNS) == expected_manifest(listed(docs))


def test_a_tree_of_several_rounds_of_blocks():
    """What the rounds do, on blocks of 64 leaves: each round's roots are appended again."""
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(64 * 64 + 3)]
    want = levels_of([x.hex() for x in digests])

    def grow(nodes):
        if len(nodes) <= 64:
            block = merkle.Appender(None)
            for x in nodes:
                block.append(x)
            return block.finish()
        roots, ways = [], []
        for k in range(0, len(nodes), 64):
            block = merkle.Appender(2)
            for x in nodes[k:k + 64]:
                block.append(x)
            root, some = block.finish()
            roots.append(root)
            ways.append(some)
        root, above = grow(roots)
        return root, [x + rest for some, rest in zip(ways, above) for x in some]

    root, ways = grow(digests)
    assert root.hex() == want[-1][0]
    for k in (0, 1, 63, 64, 4095, 4096, 4098):
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in merkle.steps_of(ways[k])] == list(way_of(want, k))
        assert merkle.fold(digests[k], ways[k]) == root
