"""One query for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.llm import (
    alignment,
    byte_bpe,
    exact,
    language_id,
    lines,
    merkle,
    mixing,
    neighbours,
    pii,
    secrets,
    simhash,
    url_rules,
    warc,
)
from tablerelay.llm.common import read, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~out))
    return language_id.identified(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The key of the pseudonyms of this query; a real one comes from where secrets are kept.
PII_KEY = "a key for the test tables"


@query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


SQL["op2_source_mix"] = r"""
WITH sized AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS body,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h
    FROM documents
), named AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS most, sum(source_size) OVER () * 3 / 2 AS total
    FROM named
), shared AS (
    SELECT *, most / weight AS ratio,
           (total - coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each_one
    FROM weighed
), levelled AS (
    SELECT *, (SELECT arg_min(each_one, (ratio, r)) FROM shared WHERE ratio > each_one) AS level FROM shared
), targets AS (
    SELECT source, r, source_size, coalesce(least(most::DOUBLE, weight * level), most::DOUBLE) AS target FROM levelled
), size_of_mix AS (
    SELECT greatest(1, least(1024, sum(source_size)::BIGINT * 3 // 2 // 65536)) AS block FROM named
), blocks_of AS (
    SELECT source, round(target)::BIGINT AS most, ceil(round(target) / block)::BIGINT AS n,
           coalesce(sum(ceil(round(target) / block)::BIGINT) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low,
           sum(ceil(round(target) / block)::BIGINT) OVER ()::BIGINT AS every
    FROM targets, size_of_mix
), steps AS (
    SELECT every, (SELECT min(g) FROM range(round(every * 0.6180339887498949)::BIGINT, round(every * 0.6180339887498949)::BIGINT + 1000) t(g) WHERE gcd(g, every) = 1) AS step
    FROM (SELECT any_value(every) AS every FROM blocks_of)
), slots AS (
    SELECT source, j AS slot, row_number() OVER (PARTITION BY source ORDER BY j) - 1 AS block_no
    FROM (SELECT j, (j * step % every)::BIGINT AS point FROM steps, unnest(range(0, every)) AS t(j)) JOIN blocks_of ON point >= low AND point < low + n
), streamed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size, body, row_id ROWS UNBOUNDED PRECEDING) - size AS start FROM sized
), taking AS (
    SELECT doc_id, s.source, size, t.source_size, t.target, start,
           (greatest(0, least(size, most - start)) + greatest(0, least(size, most - t.source_size - start)))::BIGINT AS taken
    FROM streamed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN blocks_of b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, taken, slot
FROM taking t JOIN size_of_mix ON true LEFT JOIN slots s ON s.source IS NOT DISTINCT FROM t.source AND s.block_no = t.start // block AND taken > 0
"""


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).drop("text")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"), work_folder(spark, "warc"))


#: Five bits a letter: hex digits spelt as bits, and every fifth bit on names one of 32 letters.
SQL["op6_warc"] = """
WITH whole AS (
    SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS n,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), bits AS (
    SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
        right('000' || bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), 'string_agg', '') AS b FROM whole
)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda k: substr(b, (5 * i + k + 1)::INT, 1)::INT << (4 - k)::INT))::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

#: Fixed values of the contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_rules.judged(pages, URL_RULES, *url_rules.blocking_rules(pages.join(bad, "page_id").select("url", "bad")))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def _spans_sql(kind: int, pattern: str, keep: str = "true") -> str:
    text, quoted_pattern = "coalesce(text, '')", pattern.replace("'", "''")
    return f"""
    SELECT row_id, {kind} AS kind, start, start + length(hit) AS stop FROM (
        SELECT row_id, unnest(h) AS hit, unnest(list_transform(h, lambda x, i:
            list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0)))::BIGINT AS start
        FROM (SELECT row_id, string_split_regex({text}, '{quoted_pattern}') AS g, regexp_extract_all({text}, '{quoted_pattern}') AS h FROM rows_of)
    ) WHERE {keep}"""


_VALUE = secrets.ASSIGN_VALUE.replace("'", "''")
_REACH = "a.row_id = b.row_id AND b.start <= a.stop + 400 AND b.stop + 400 >= a.start"
SQL["op5_secret_scan"] = f"""
WITH rows_of AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
base AS ({_spans_sql(0, secrets.ASSIGN, f"length(regexp_extract(hit, '{_VALUE}', 1)) >= 8")}
    UNION ALL {_spans_sql(1, secrets.ACCESS)} UNION ALL {_spans_sql(2, secrets.HEX)}),
ident AS ({_spans_sql(3, secrets.IDENT)}),
lone AS (SELECT * FROM ({_spans_sql(4, secrets.LONE, "length(hit) = 40")}) a
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE a.row_id = b.row_id AND b.start < a.stop AND b.stop > a.start)),
endpoint AS ({_spans_sql(5, secrets.ENDPOINT)}),
identifiers AS (SELECT * FROM base WHERE kind = 1 UNION ALL SELECT * FROM ident),
secret_parts AS (SELECT * FROM base WHERE kind IN (0, 2) UNION ALL SELECT * FROM lone),
spans AS (
    SELECT * FROM base
    UNION ALL SELECT * FROM ident a WHERE EXISTS (SELECT 1 FROM secret_parts b WHERE {_REACH})
    UNION ALL SELECT * FROM lone a WHERE EXISTS (SELECT 1 FROM identifiers b WHERE {_REACH})
    UNION ALL SELECT * FROM endpoint a WHERE EXISTS (SELECT 1 FROM secret_parts b WHERE {_REACH}) AND EXISTS (SELECT 1 FROM identifiers b WHERE {_REACH})
), told AS (
    SELECT row_id, kind, start, ['assign', 'access', 'hex', 'ident', 'lone', 'endpoint'][kind + 1] || ':' || start || ':' || stop AS s FROM spans
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM rows_of LEFT JOIN told USING (row_id) GROUP BY row_id
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL["op11_line_dedup"] = rf"""
WITH rows_of AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents),
each AS (SELECT row_id, doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS place FROM rows_of),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM each),
repeated AS (
    SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k
    HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > 1
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT row_id, doc_id, line, place, first_id IS NOT NULL AND doc_id IS DISTINCT FROM first_id AS gone FROM keyed LEFT JOIN repeated USING (k))
GROUP BY row_id
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents"), a, b)[0]


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


#: The check sum bit by bit, as SQL has no function for it.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of every level, from (tree, pos, n, digest)."""
    return f"""{name}(tree, level, pos, n, digest) AS (
    SELECT tree, 0, pos, n, digest FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
    FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8
)"""


def _steps_sql(nodes: str) -> str:
    """What stands to the left and to the right of every node in its run."""
    return f"""SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL"""


SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS changed
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS pos,
           count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM hashed
), {_tree_sql("nodes", "leaves")}, subroots AS (SELECT tree AS name, digest AS subroot FROM nodes WHERE n = 1),
trees AS (SELECT 'all' AS tree, name, subroot AS digest, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM subroots),
{_tree_sql("over", "trees")}, ways AS (
    SELECT row_id, s.level, before, after FROM leaves l JOIN ({_steps_sql("nodes")}) s ON s.tree = l.tree AND s.pos = l.pos // (8 ** s.level)::BIGINT
    UNION ALL
    SELECT row_id, 100 + s.level, before, after FROM leaves l JOIN trees t ON t.name = l.tree
    JOIN ({_steps_sql("over")}) s ON s.pos = t.pos // (8 ** s.level)::BIGINT
), numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY level) AS step FROM ways),
proofs AS (SELECT row_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM numbered GROUP BY row_id),
folded(row_id, step, x) AS (
    SELECT row_id, 0, changed FROM leaves
    UNION ALL
    SELECT f.row_id, f.step + 1, sha256(before || x || after) FROM folded f JOIN numbered w ON w.row_id = f.row_id AND w.step = f.step + 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN (SELECT digest AS root FROM over WHERE n = 1) ON true
LEFT JOIN proofs USING (row_id) JOIN (SELECT row_id, arg_max(x, step) AS folded_root FROM folded GROUP BY row_id) USING (row_id)
"""
