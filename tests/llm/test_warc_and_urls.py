"""WARC archives by round trip, and URL rules against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablerelay.llm import url_rules, warc
from tests.llm.conftest import rows_of, sentence

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


NO_ID = 2**63


def expected(rows):
    """Of equal payloads the first row with the smallest id is the response."""
    first = {}
    for page_id, _, html in rows:
        place = NO_ID if page_id is None else page_id
        first[html or ""] = min(first.get(html or "", NO_ID), place)
    out, seen = [], set()
    for page_id, _, html in rows:
        text = html or ""
        data = text.encode()
        is_first = (NO_ID if page_id is None else page_id) == first[text] and text not in seen
        if is_first:
            seen.add(text)
        refers = None if is_first or first[text] == NO_ID else first[text]
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_first else "revisit", refers))
    return sorted(out, key=repr)


def pages_of(spark):
    rng = random.Random(9)
    rows = [(k, f"http://x.example/{k}", sentence(rng, rng.randint(1, 300))) for k in range(60)]
    rows += [(100 + k, "http://copy.example/", "<p>same é 漢</p>") for k in range(30)]
    rows += [(7, "http://x.example/again", rows[7][2]), (7, None, "other text, same id"), (None, "u", "no id"), (None, "u", "no id"), (200, None, None), (201, "a b\r\nc", ""),
             (202, "http://big.example", "".join(rng.choice("abcdefgh<>/ \n") for _ in range(400_000))), (203, "http://bytes.example", "\x1f\x00 \r\n\r\nWARC/1.1\r\n")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("range_bytes", [warc.RANGE, 5_000])
def test_round_trip(spark, tmp_path, range_bytes, monkeypatch):
    rows, pages = pages_of(spark)
    monkeypatch.setattr(warc, "RANGE", range_bytes)
    folder = f"file://{tmp_path}/warc"
    more = pages.repartition(3).withColumn("refers_to", F.lit("mine")).withColumn("record_type", F.lit(1))
    assert rows_of(warc.archived_pages(more, folder), *COLUMNS) == expected(rows)
    read = warc.read_archives(spark, folder, range_bytes=range_bytes)
    payloads = Counter(bytes(r.payload) for r in read.filter("record_type = 'response'").collect())
    assert payloads == Counter((html or "").encode() for html in {h or "" for _, _, h in rows})


def test_no_pages(spark, tmp_path):
    _, pages = pages_of(spark)
    out = warc.archived_pages(pages.filter("false"), f"file://{tmp_path}/none")
    assert out.collect() == [] and tuple(out.columns) == COLUMNS
    assert warc.read_archives(spark, f"file://{tmp_path}/nowhere").collect() == []


def test_smaller_payloads_than_the_bound_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = rows_of(warc.archived_pages(pages, f"file://{tmp_path}/least", least=3), "page_id", "record_type", "refers_to")
    assert out == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_any_cut_into_ranges_owns_every_record_once(tmp_path):
    members = [warc.record_bytes(str(k), "http://u", bytes([65 + k]) * (k * 50), None if k % 2 else "0") for k in range(12)]
    junk = b"\x1f\x8b\x08 not a member \x1f\x8b\x08\x00" + gzip.compress(b"no record")
    data = members[0] + junk + b"".join(members[1:])
    assert gzip.decompress(b"".join(members)).count(b"WARC/1.1\r\n") == 12
    for size in (1, 2, 7, 64, 333, len(data)):
        found = [r["record_id"] for start in range(0, len(data), size) for r in warc.records(pa.BufferReader(data), start, start + size)]
        assert found == [str(k) for k in range(12)]


def test_a_cut_off_archive_gives_what_is_whole():
    data = b"".join(warc.record_bytes(str(k), "u", b"text" * 40, None) for k in range(3))
    assert [r["record_id"] for r in warc.records(pa.BufferReader(data[:-5]), 0, len(data))] == ["0", "1"]


URLS = [
    "http://a.net/", "http://A.NET/x", "http://a.net", "http://sub.example.net/en/1", "http://sub.example.net/de/1", "https://example.com/de/x?y#z",
    "https://example.com/dex", "http://notexample.com/de/", "http://x.org/fr/", "http://org/fr/", "ftp://u@x.net:80/", None, "", "no scheme.net/", "://net/",
    "http://net?x/", "http://b.net#/", "http://ÀB.net/É", "http://x.net/a://y.org/fr/",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, "allow"))


def test_given_rules(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("confidence", F.lit("mine")).withColumn("host", F.lit("mine"))
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    none = url_rules.mine_rules(pages.select("url", F.lit(None).cast("boolean").alias("bad")))
    out = rows_of(url_rules.judged(pages, rules, none), "page_id", "host", "path", "rule", "verdict")
    assert out == sorted(((i, *plain(u)[:2], *plain(u)[2]) for i, u in rows), key=repr)
    assert url_rules.judged(pages.filter("false"), rules, none).collect() == []


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        words = rng.sample(["alpha", "beta", "gamma", "delta", "win", "casino", "page", "html"], 4)
        bad = ("win" in words and "casino" in words) if rng.random() < 0.95 else rng.random() < 0.3
        rows.append((f"http://{words[0]}.example.com/{words[1]}/{words[2]}-{words[3]}/{k}", bad))
    rows += [(None, True), ("http://x", None), ("", True)]
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_mined_rules_equal_brute_force(labelled):
    """Every set of tokens with the support and the confidence is a rule, and no other."""
    rules = {tuple(r.tokens): round(r.confidence, 9) for r in url_rules.mine_rules(labelled, confidence=0.8, least_count=30).collect()}
    sets = []
    for r in labelled.collect():
        if r.url and r.bad is not None:
            sets.append((frozenset(re.findall(r"[^\W_]+", r.url.lower())), r.bad))
    n = len(sets)
    least = max(0.01, 30 / n) * n
    tokens = [t for t, c in Counter(t for s, bad in sets if bad for t in s).items() if c >= least]
    wanted = {}
    for size in range(1, len(tokens) + 1):
        for some in itertools.combinations(sorted(tokens), size):
            having = [bad for s, bad in sets if s.issuperset(some)]
            if sum(having) >= least and sum(having) / len(having) >= 0.8:
                wanted[some] = round(sum(having) / len(having), 9)
    assert rules == wanted and wanted
    assert all({"win", "casino"} <= set(t) for t in rules)


def test_mined_rules_block_what_has_all_their_tokens(spark, labelled):
    mined = url_rules.mine_rules(labelled)
    pages = spark.createDataFrame([(1, "http://a.org/CASINO?win"), (2, "http://a.org/casino"), (3, "http://a.net/casino-win"), (4, "http://example.net/en/casino/win"), (5, None)], "page_id long, url string")
    rules = (("net/", "block"), ("example.net/en/", "allow"))
    out = rows_of(url_rules.judged(pages, rules, mined), "page_id", "rule", "verdict")
    assert out[0][2] in ("allow", "block")
    blocks = {(p, r, v) for p, r, v in out}
    assert {(2, None, "allow"), (3, "net/", "block"), (4, "example.net/en/", "allow"), (5, None, "allow")} <= blocks
    every = {tuple(r.tokens) for r in mined.collect()}
    has = any(set(t) <= {"http", "a", "org", "casino", "win"} for t in every)
    assert ((1, None, "block") in blocks) == has


@pytest.mark.parametrize("spam", [29, 30, 40])
def test_the_floor_is_a_count_at_every_size(spark, spam):
    """Bad URLs of one host, far below one in a hundred, give a rule from 30 on."""
    rows = [(f"http://h{k % 50}.example.com/p{k}", False) for k in range(6000)] + [(f"http://casino.example.com/q{k}", True) for k in range(spam)]
    rows += [(f"/z{k}", False) for k in range(3000)]  # without a token that any rule could have
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = url_rules.mine_rules(labelled)
    assert any(r.tokens == ["casino"] and r.confidence == 1.0 for r in mined.collect()) == (spam >= 30)
    pages = spark.createDataFrame([(1, "http://casino.example.com/new")], "page_id long, url string")
    assert url_rules.judged(pages, (), mined).first().verdict == ("block" if spam >= 30 else "allow")


def blocked_by_all_sets(labelled, pages, least=30, confidence=0.8):
    """URLs that any set of tokens with the support and the confidence blocks: for each URL all
    its subsets."""
    tokens = lambda url: frozenset(re.findall(r"[^\W_]+", url.lower()))
    sets = [(tokens(u), bad) for u, bad in labelled if u is not None and bad is not None]
    often = {t for t, c in Counter(t for s, bad in sets if bad for t in s).items() if c >= least}
    told, out = {}, set()
    for url in pages:
        some = sorted(tokens(url) & often)
        for size in range(1, len(some) + 1):
            for part in itertools.combinations(some, size):
                if part not in told:
                    having = [bad for s, bad in sets if s.issuperset(part)]
                    told[part] = sum(having) >= least and sum(having) / len(having) >= confidence
                if told[part]:
                    out.add(url)
    return out


def test_minimal_rules_have_the_verdicts_of_all_sets(spark, labelled):
    """Above 3,000 rows, with tokens of the same rows, copies and rules of one, two and three tokens."""
    rng = random.Random(8)
    rows = [tuple(r) for r in labelled.collect()]
    rows += [("http://spam.biz/win/big/now?again", True)] * 45 + [("http://spam.biz/win/big/now?again", False)] * 5
    rows += [(f"http://news.org/{rng.choice('abc')}/{k % 40}", rng.random() < 0.02) for k in range(2500)]
    for k in range(400):
        words = rng.sample(["red", "green", "blue", "pink"], 3)
        rows.append((f"http://x.info/{'-'.join(words)}/{k}", {"red", "green", "blue"} == set(words)))
    assert len(rows) > 4000
    rules, names = url_rules.blocking_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    pages = sorted({u for u, _ in rows if u}) + ["http://big.example.com/", "http://q.com/blue/red/green", "http://q.com/red/green", "/again", "none"]
    frame = spark.createDataFrame(list(enumerate(pages)) + [(-1, None)], "page_id long, url string")
    found = {pages[r.page_id] for r in url_rules.judged(frame, (), rules, names).collect() if r.verdict == "block"}
    assert found == blocked_by_all_sets(rows, pages)
    assert {len(r.tokens) for r in rules.collect()} == {1, 2, 3}
    none = url_rules.blocking_rules(spark.createDataFrame([], "url string, bad boolean"))
    assert {r.verdict for r in url_rules.judged(frame, (), *none).collect()} == {"allow"}


@pytest.mark.parametrize("copies", [29, 30])
def test_copies_of_a_long_url_give_one_rule(spark, copies):
    url = "http://" + "/".join(f"t{k}" for k in range(60)) + "/" + "x" * 50_000
    rows = [(url, True)] * copies + [(f"http://fine.org/{k}", False) for k in range(200)]
    rules, names = url_rules.blocking_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert rules.count() == (1 if copies >= 30 else 0)
    pages = spark.createDataFrame([(1, url), (2, "http://fine.org/1"), (2, "http://fine.org/1"), (3, "a/t7/b")], "page_id long, url string")
    block = "block" if copies >= 30 else "allow"
    assert rows_of(url_rules.judged(pages, (), rules, names), "page_id", "verdict") == [(1, block), (2, "allow"), (2, "allow"), (3, block)]


@pytest.mark.parametrize("damage", ["cut", "flip"])
def test_a_damaged_archive_fails(spark, tmp_path, damage):
    _, pages = pages_of(spark)
    folder = f"file://{tmp_path}/warc"
    n = len(warc.archived_pages(pages.repartition(2), folder).collect())
    path = sorted((tmp_path / "warc").glob("*.gz"))[0]
    data = bytearray(path.read_bytes())
    if damage == "cut":
        data = data[:-40]
    else:
        data[len(data) // 2:len(data) // 2 + 20] = bytes(20)
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="were read back|broken payload"):
        warc.read_back(spark, folder, n).collect()
