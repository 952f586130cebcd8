"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents, in hashed order, are one stream of words, read twice at most and
cut into blocks of equal words, as many as hold its target. Slot ``j`` of the mix's ``n`` has the
golden-ratio point ``j * g mod n``, with ``g`` next to ``n`` over the golden ratio and without a
common factor, so that each of the ``n`` points comes once; it falls into one source's interval
of the cumulated blocks. A slot's rank among its source's slots is the block it takes, and a
source's last block is cut to its target. So any stretch of the mix is near the weights, and
each source has its target, however small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablerelay.llm.common import WORD, word_count, written

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words, as a fraction; a source gives no more than MOST times its own.
SHARE, MOST = (3, 2), 2
#: One over the golden ratio.
GOLDEN = 0.6180339887498949
#: Words of a block: at most this, and fewer in a small mix, so that it has this many slots.
BLOCK, SLOTS = 1024, 65_536
#: Cells that points and intervals are matched by, for each source at least.
CELLS = 4096

KEY = ["no_source", "source_key"]
#: Documents that agree in all of these are copies of one entry.
ENTRY = ["id_key", "no_id", *KEY, "one_size", "text_hash"]


@dataclass
class Mix:
    """Rows of the parts of a mix; all are tables in the shared folder or plans over them."""

    entries: DataFrame  #: id, source, text hash and size of a document, and how many copies it has
    targets: DataFrame  #: source, source_size, weight, target
    slots: DataFrame  #: slot, source, block
    pieces: DataFrame  #: entry, start in its source's stream, pass, slot, block and words taken
    block: int


def entry_columns() -> list[Column]:
    """What tells documents apart, without nulls, so that plain joins find them again."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("no_id"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("one_size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    ]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weight and target of every source, one row each.

    In the order of most over weight, a source is held to its most while that is below its
    share of what is left; from the first that isn't, all get the same words a weight.
    ``sizes``: no_source, source_key, source_size. Sources are metadata, a row for each: the
    only rows here that are ordered in one task.
    """
    by_name = Window.orderBy(*KEY)
    by_ratio = Window.orderBy("ratio", *KEY)
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(everything) * SHARE[0] / SHARE[1]
    ranked = sizes.withColumn("weight", weight).withColumns({"most": F.lit(MOST) * F.col("source_size"), "total": total})
    shared = ranked.withColumn("ratio", F.col("most") / F.col("weight")).withColumn(
        "each", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    level = F.min(F.when(F.col("ratio") > F.col("each"), F.struct("ratio", *KEY, "each"))).over(everything)["each"]
    return shared.withColumn("level", level).select(
        *KEY, "source_size", "weight", F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")), F.col("most").cast("double")).alias("target")
    )


def before_in_order(df: DataFrame, key: list[str], chunk: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the earlier rows of the key.

    A key may hold a third of all rows, so it is ordered chunk by chunk, and a chunk's own
    start comes from the sums of the chunks before it.
    """
    inner = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key, chunk).agg(F.sum(value).alias("_sum")).select(
        *key, chunk, F.coalesce(F.sum("_sum").over(chunks), F.lit(0)).alias("_start")
    )
    return (
        df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(starts, [*key, chunk]).withColumn("before", F.col("_start") + F.col("_inner")).drop("_start", "_inner")
    )


def step_of(points: int) -> int:
    """Next to ``points`` over the golden ratio, without a common factor: its multiples meet all points."""
    step = max(1, round(points * GOLDEN))
    while math.gcd(step, points) > 1:
        step += 1
    return step


def schedule(spark: SparkSession, targets: DataFrame, slots: int) -> DataFrame:
    """``slot``, its source and ``block``: the slot's rank among those of its source.

    Slots are shared out by the rounded targets, exactly where these divide them.
    """
    cells = max(CELLS, 1 << (4 * targets.count()).bit_length())
    width = max(1, slots // cells)
    by_name = Window.orderBy(*KEY)
    ends = targets.withColumn("words", F.round("target").cast("long")).withColumns({
        "high": F.sum("words").over(by_name.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("words").over(Window.partitionBy()),
    })
    # Products of slots and words can be too long for 64 bits.
    wide = lambda number: (F.lit(number) if isinstance(number, int) else number).cast("decimal(19,0)")
    point = lambda words: F.floor(wide(words) * wide(slots) / F.col("all")).cast("long")
    intervals = ends.filter("words > 0").select(*KEY, point(F.col("high") - F.col("words")).alias("low"), point(F.col("high")).alias("high")).filter("low < high")
    in_cells = intervals.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    points = spark.range(0, slots, 1, max(1, -(-slots // 500_000))).select(
        F.col("id").alias("slot"), (wide(F.col("id")) * wide(step_of(max(1, slots))) % wide(max(1, slots))).cast("long").alias("point")
    ).withColumn("cell", F.expr(f"point div {width}"))
    placed = points.join(in_cells, "cell").filter("point >= low and point < high").select(
        "slot", *KEY, F.expr("slot div 65536").alias("chunk"), F.lit(1).alias("one")
    )
    return before_in_order(placed, KEY, "chunk", ["slot"], "one").select("slot", *KEY, F.col("before").alias("block"))


def order_of() -> Column:
    """The order of a source's documents: by a hash of the id, or of the text where there is none."""
    return F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))


def mix(docs: DataFrame) -> Mix:
    """The mix of ``docs`` (doc_id, text, source); null text has no words."""
    spark = docs.sparkSession
    entries = written(
        docs.select(*entry_columns(), order_of().alias("order")).groupBy(*ENTRY, "order").agg(F.count("*").alias("copies")), "mix-entries"
    )
    sizes = entries.groupBy(*KEY).agg(F.sum(F.col("one_size") * F.col("copies")).alias("source_size"))
    targets = written(source_targets(sizes), "mix-targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    share = total * SHARE[0] // SHARE[1]
    block = max(1, min(BLOCK, share // SLOTS))
    blocks = targets.withColumn("target", F.ceil(F.round("target") / block))
    every = int(blocks.agg(F.sum("target")).first()[0] or 0)
    slots = written(schedule(spark, blocks, every), "mix-slots")
    streamed = before_in_order(
        entries.filter("one_size > 0").withColumn("size", F.col("one_size") * F.col("copies")).withColumn("chunk", F.substring("order", 1, 3)),
        KEY, "chunk", ["order", *ENTRY], "size",
    )
    of_source = targets.select(*KEY, "source_size", F.round("target").cast("long").alias("most"))
    passes = streamed.join(of_source, KEY).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")
    ).withColumn("start", F.col("pass") * F.col("source_size") + F.col("before")).withColumn("end", F.least(F.col("start") + F.col("size"), "most")).filter("start < end")
    pieces = passes.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}")))).select(
        *ENTRY, F.col("before").alias("at"), "pass", "block",
        (F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"),
    )
    return Mix(entries, targets, slots, pieces.join(slots, [*KEY, "block"]), block)


def _taken(of: Mix) -> DataFrame:
    """Words that the mix takes of each entry in each pass, and where it stands in its source's
    stream: one row an entry."""
    both = [F.sum(F.when(F.col("pass") == k, F.col("words")).otherwise(0)).alias(f"pass_{k}") for k in (0, 1)]
    return of.pieces.groupBy(*ENTRY).agg(*both, F.first("at").alias("at"))


def _with_slots(rows: DataFrame, of: Mix, copy: Column, size: Column) -> DataFrame:
    """``rows`` with ``slot``, the one whose block holds the first word taken of a copy."""
    first = F.floor((F.col("at") + copy * size) / of.block).cast("long")
    return rows.withColumn("_block", first).join(of.slots.withColumnRenamed("block", "_block"), [*KEY, "_block"], "left").drop("_block")


def _of_copy(k: int, copy: Column, size: Column) -> Column:
    """Of the copies of an entry, which follow each other in the stream, what one gives."""
    rest = F.coalesce(F.col(f"pass_{k}"), F.lit(0)) - copy * size
    return F.greatest(F.lit(0), F.least(rest, size)).cast("long")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken, and the
    slot of the mix where the first of them stands (null where none is taken).

    Rows that repeat one another whole share their words in order. Texts without words and
    null texts take nothing; a null source is a source of its own, last in order; an empty
    table gives no rows; columns other than doc_id, text and source are not read.
    """
    of = mix(docs)
    rows = of.entries.join(_taken(of), ENTRY, "left")
    copies = rows.join(of.targets, KEY).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    taken = sum(_of_copy(k, F.col("copy"), F.col("one_size")) for k in (0, 1))
    return _with_slots(copies, of, F.col("copy"), F.col("one_size")).select(
        F.when(~F.col("no_id"), F.col("id_key")).alias("doc_id"), F.col("one_size").alias("size"), "source_size", "target",
        taken.alias("taken"), F.when(taken > 0, F.col("slot")).alias("slot"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each pass that takes words of it.

    Where the end of a source's share cuts a document, the row has its text up to the end of the
    last word taken, unchanged, and ``n_chars``, if there, is counted anew. Documents without words
    go. Rows have no order; :func:`mix_sizes` tells each document's slot.
    """
    of = mix(docs)
    own = [f"_{c}" for c in ENTRY]
    taken = _taken(of).drop("at").withColumnsRenamed(dict(zip(ENTRY, own)))
    marked = docs.select("*", *(c.alias(name) for c, name in zip(entry_columns(), own)))
    joined = marked.join(taken, own).withColumn("_copy", F.row_number().over(Window.partitionBy(*own).orderBy(*own)) - 1)
    rows = joined.withColumn("_words", F.explode(F.array(*(_of_copy(k, F.col("_copy"), F.col("_one_size")) for k in (0, 1))))).filter("_words > 0")
    # Up to where the last word taken ends: as many gaps as words come before it, the first one maybe empty.
    some = lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.col("_words").cast("int")), F.lit(0), lambda n, part: n + F.length(part))
    end = some(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"))) + some(F.split("text", WORD, -1))
    text = F.when(F.col("_words") < F.col("_one_size"), F.col("text").substr(F.lit(1), end)).otherwise(F.col("text"))
    cut = rows.withColumn("text", text)
    columns = docs.columns
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(F.col(f"`{c}`") for c in columns))
