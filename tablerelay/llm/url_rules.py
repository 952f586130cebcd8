"""URL filters: given host and path rules first, then rules that FP-growth mines.

A labelled URL is the set of its tokens and, where its label says so, of ``BAD``. Token sets
whose URLs are bad with enough confidence and support block. They are matched by an inverted
index: a rule is filed under the rarest of its tokens, met by the URLs that have it, and its
other tokens are looked up in the URL.

Most of those sets say nothing new: tokens that occur in the same URLs stand for each other,
and what contains a blocking set blocks anyway. :func:`blocking_rules` mines one item for all
tokens of the same URLs, and only items that don't block alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.llm.common import quoted, written

#: Support of a token set: so many bad URLs, however many are labelled.
LEAST_COUNT = 30
#: How many of a rule's URLs have to be bad.
CONFIDENCE = 0.8
#: Stands for the label in a token set; no token has this character.
BAD = "\x00bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def tokens_of(url: Column) -> Column:
    """The distinct runs of letters and digits of a URL, lower-cased; none of null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)")))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(length, rule, verdict) of the longest of the given (``host/path``, verdict) that fits.

    The rules are a setting and are compared in turn; a tie goes to the first by name.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, slash, rest = rule.partition("/")
        of_host = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(of_host & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def mine_rules(labelled: DataFrame, *, least_count: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """``tokens``, ``first`` (the rarest of them) and ``confidence`` of the blocking rules.

    ``labelled``: ``url`` and ``bad`` (boolean). All labelled rows count; too few of them, or
    none, give no rules. Every set counts as a rule here, so there are 2^n of n tokens that
    come together; :func:`blocking_rules` has the same verdicts without that.
    """
    spark = labelled.sparkSession
    sets = written(
        labelled.filter("url is not null and bad is not null")
        .select(tokens_of(F.col("url")).alias("tokens"), "bad").filter("size(tokens) > 0")
        .select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")), "url-sets"
    )
    bad = sets.agg(F.count_if(F.array_contains("items", BAD))).first()[0]
    if bad < max(1, least_count):
        return spark.createDataFrame([], "tokens array<string>, first string, confidence double")
    # Only tokens that reach the support together with BAD can be in a rule: the others needn't be mined.
    singles = sets.filter(F.array_contains("items", BAD)).select(F.explode("items").alias("token")).groupBy("token").count().filter(F.col("count") >= least_count)
    each = sets.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("items").alias("token"))
    useful = written(each.join(singles, "token").groupBy("row").agg(F.collect_list("token").alias("items")).select("items"), "url-items")
    # FP-growth rounds the share of its rows up to a count: half of one less keeps that exact.
    share = max(0.0, (least_count - 0.5) / useful.count())
    model = FPGrowth(minSupport=share, minConfidence=confidence, numPartitions=sets.sparkSession.sparkContext.defaultParallelism).fit(useful)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    counts = written(sets.select(F.explode("items").alias("token")).groupBy("token").count(), "url-token-counts")
    rarest = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens").agg(
        F.min(F.struct("count", "token"))["token"].alias("first"), F.first("confidence").alias("confidence")
    )
    return written(rarest, "url-rules")


def blocking_rules(labelled: DataFrame, *, least_count: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The minimal blocking rules over items, and the items' names: ``token`` and ``item``.

    They block just the URLs that all sets with the support and the confidence would: a set
    of tokens has them exactly if the set of its items has, and a set with them blocks where one
    of its subsets does. Copies of one URL, however long, have one item, so a rule. A token
    counts only if that many bad URLs have it; all labelled rows count.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    # Equal URLs are counted together before anything is made of their tokens.
    sets = rows.groupBy(F.array_sort("tokens").alias("tokens"), "bad").agg(F.count("*").alias("n"))
    sets = written(sets.withColumn("row", F.xxhash64("tokens")), "url-sets")
    each = sets.select("row", "bad", "n", F.explode("tokens").alias("token"))
    # Tokens of the same rows agree in the sums of these: all but surely only they do.
    mark = F.xxhash64("row", "bad", "n")
    tokens = each.groupBy("token").agg(
        F.sum("n").alias("urls"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad_urls"),
        F.sum(mark.cast("decimal(38,0)")).alias("summed"), F.bit_xor(F.xxhash64(F.lit(1), mark)).alias("mixed"),
    ).filter(F.col("bad_urls") >= least_count)
    same = tokens.groupBy("urls", "bad_urls", "summed", "mixed").agg(F.min("token").alias("item"))
    names = written(
        tokens.join(same, ["urls", "bad_urls", "summed", "mixed"])
        .select("token", "item", "urls", (F.col("bad_urls") / F.col("urls")).alias("share")), "url-items"
    )
    alone = names.filter(F.col("share") >= confidence).select(F.array("item").alias("tokens"), F.col("item").alias("first"), F.col("share").alias("confidence")).distinct()
    left = names.filter((F.col("share") < confidence) & (F.col("token") == F.col("item")))
    # Transactions as often as their URLs come; equal ones of several URLs are one row here.
    held = each.join(left.select("token"), "token").groupBy("row", "bad", "n").agg(F.array_sort(F.collect_list("token")).alias("items"))
    useful = written(held.groupBy("items", "bad").agg(F.sum("n").alias("n")), "url-transactions")
    several = useful.filter("size(items) > 1")
    if several.filter("bad").isEmpty():
        return written(alone, "url-rules"), names
    marked = F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")
    whole = several.select(marked, F.explode(F.expr("sequence(1L, n)")).alias("_copy")).select("items")
    share = max(0.0, (least_count - 0.5) / whole.count())
    model = FPGrowth(minSupport=share, minConfidence=confidence, numPartitions=spark.sparkContext.defaultParallelism).fit(whole)
    found = written(
        model.associationRules.filter(F.col("consequent")[0] == BAD).filter("size(antecedent) > 1")
        .select(F.array_sort("antecedent").alias("tokens"), "confidence"), "url-sets-found"
    )
    # Minimal ones: no rule with an item less. Every rule's subsets by one item are looked up.
    less = found.select("tokens", F.explode("tokens").alias("gone")).select("tokens", F.array_remove("tokens", F.col("gone")).alias("part"))
    over = less.join(found.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    minimal = found.join(over, "tokens", "left_anti")
    counts = left.select("token", "urls")
    rarest = minimal.select("tokens", "confidence", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens").agg(
        F.min(F.struct("urls", "token"))["token"].alias("first"), F.first("confidence").alias("confidence")
    )
    return written(alone.unionByName(rarest), "url-rules"), names


def matching(pages: DataFrame, rules: DataFrame, url: str = "url", names: DataFrame | None = None) -> DataFrame:
    """``url`` and the highest ``confidence`` among the mined rules it has all tokens of, or,
    with ``names``, all items of."""
    urls = pages.select(F.col(quoted(url)).alias("url")).filter("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    if names is not None:
        told = urls.select("url", F.explode("tokens").alias("token")).join(names.select("token", "item"), "token")
        urls = told.groupBy("url").agg(F.collect_set("item").alias("tokens"))
    met = urls.select("url", "tokens", F.explode("tokens").alias("first")).join(rules.withColumnRenamed("tokens", "wanted"), "first")
    return met.filter(F.forall("wanted", lambda t: F.array_contains("tokens", t))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], mined: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per page: host, path, the given rule that decides (else null) and the verdict.

    A null url, or one without ``://``, has empty host and path, and a null one is allowed.
    Where no given rule fits, a URL that a mined rule matches is blocked and others are
    allowed. Rows that repeat stay; an empty table gives no rows; other columns are not read.
    """
    parsed = pages.select("page_id", "url", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    given = parsed.withColumn("given", longest_rule(F.col("host"), F.col("path"), rules))
    return given.join(matching(pages, mined, names=names), "url", "left").select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
