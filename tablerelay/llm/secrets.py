"""Secret scans that link the parts of a credential.

Some spans are secrets by their form: assigned ones, access ids and long hex. Others are only
weak candidates: the name of an account, a token without a name, an endpoint. They are
reported when what completes them lies within the same SCOPE of text: an identifier needs a
secret, a secret an identifier, an endpoint both. Candidates meet by an interval join on the
bins of their document that their scopes touch.

Everything is a built-in function or a join; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.llm.common import written
from tablerelay.llm.spans import find_spans

#: Fixed values of the contract: kinds in their order, and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters and more; a shorter run of these holds no longer one
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8

#: Weak candidates.
IDENT = r"""(?i:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]+"""
LONE = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(?i:https?|wss?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:@%/-]+"""
LONE_LENGTH = 40

KINDS = ("assign", "access", "hex", "ident", "lone", "endpoint")
#: Code points between the parts of a credential.
SCOPE = 400
KEY = ["id_key", "no_id", "text_hash"]


#: What every long hex number and every lone token begins with.
LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"


def _names_values(text: Column) -> Column:
    return text.contains("=") | text.contains(":")


def base_spans(text: Column) -> dict[str, Column]:
    assigned = F.filter(find_spans(text, ASSIGN, _names_values(text)), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= LEAST_ASSIGNED)
    return {"assign": assigned, "access": find_spans(text, ACCESS, text.contains("AKIA")), "hex": find_spans(text, HEX, text.rlike(LONG_RUN))}


def weak_spans(text: Column) -> dict[str, Column]:
    return {
        "ident": find_spans(text, IDENT, _names_values(text)),
        "lone": F.filter(find_spans(text, LONE, text.rlike(LONG_RUN)), lambda s: F.length(s["hit"]) == LONE_LENGTH),
        "endpoint": find_spans(text, ENDPOINT, text.contains("://")),
    }


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document with its spans of every kind, in the shared folder."""
    text = F.coalesce("text", F.lit(""))
    places = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    found = {kind: places(spans, kind) for kind, spans in {**base_spans(text), **weak_spans(text)}.items()}
    return written(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("no_id"),
            F.xxhash64(text).alias("text_hash"), *(spans.alias(kind) for kind, spans in found.items()),
        ), "secret-spans",
    )


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that their complements confirm: KEY, start, kind, end."""
    distinct = scans.filter("size(ident) + size(lone) + size(endpoint) > 0").dropDuplicates(KEY)
    spans = written(
        distinct.select(*KEY, F.explode(F.concat(*KINDS)).alias("s")).select(*KEY, "s.*"), "secret-candidates"
    )
    of = lambda *kinds: spans.filter(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    lone = _apart(of("lone"), of("assign", "access", "hex"))
    identifiers, secrets = of("access", "ident"), of("assign", "hex").unionByName(lone)
    confirmed = _near(of("ident"), secrets, scope).unionByName(_near(lone, identifiers, scope))
    return confirmed.unionByName(_near(_near(of("endpoint"), identifiers, scope), secrets, scope))


def _near(some: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Those of ``some`` with one of ``others`` within ``scope`` in their document.

    Spans of a kind don't overlap, so a bin holds no more than its width of them.
    """
    width = 4 * scope
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    left = some.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope))
    right = others.select(*KEY, F.col("start").alias("from"), F.col("end").alias("to"), bins(F.col("start"), F.col("end")).alias("bin"))
    same = [left[c] == right[c] for c in (*KEY, "bin")]
    reach = (right["from"] <= left["end"] + scope) & (right["to"] + scope >= left["start"])
    return left.join(right, [*same, reach], "left_semi").select(*KEY, "start", "kind", "end").distinct()


def _apart(some: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``some`` that overlap none of ``others``."""
    width = 1024
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    left, right = some.withColumn("bin", bins), others.select(*KEY, F.col("start").alias("from"), F.col("end").alias("to"), bins.alias("bin"))
    same = [left[c] == right[c] for c in (*KEY, "bin")]
    over = left.join(right, [*same, right["from"] < left["end"], right["to"] > left["start"]], "left_semi").select(*KEY, "start", "kind", "end").distinct()
    return some.join(over, [*KEY, "start", "kind", "end"], "left_anti")


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then in the order of the kinds."""
    names = F.array(*map(F.lit, KINDS))
    texts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(texts, ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: how many secrets of each form, a digest of where they are, and
    all spans, confirmed weak candidates included.

    Null and empty texts have none (the digest is that of no text). Rows that repeat stay,
    with the same result; a null id stays null; an empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    scans = scanned(docs)
    added = linked(scans, scope).groupBy(*KEY).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    base = F.concat("assign", "access", "hex")
    return scans.join(added, KEY, "left").select(
        F.when(~F.col("no_id"), F.col("id_key")).alias("doc_id"),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"),
    )
