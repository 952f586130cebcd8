"""A Merkle manifest of a dataset, with a witness of every row.

Rows are leaves of a tree a group (here: a language), every eight consecutive nodes make the
next, and the trees' roots are leaves of one more tree. Witnesses are made while leaves are
appended: an appended node opens or joins a run; when the run closes, every leaf below one of
its nodes gets the others as the next step of its witness. A task appends the leaves of an
aligned block, and what is left open by then, the way from the block's root upwards, comes
from appending the blocks' roots in the same way, level by level of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerelay.llm.common import written

#: Fixed values of the contract.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels of a block, and its leaves: what one task appends at a time, 0.4 MB of digests.
LEVELS = 4
BLOCK = ARITY**LEVELS

NODES = "tree string, pos long, n long, digest binary"
WITNESSED = "tree string, pos long, witness binary"


def node_of(children: list[bytes]) -> bytes:
    """The digest of a run's digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


class Appender:
    """Appends leaves to one subtree and completes witnesses as their siblings arrive.

    A step of a witness is two bytes, how many siblings stand to the left and to the right,
    and the siblings' digests. ``levels`` is the subtree's height, or None where its root is
    the first level with a single node.
    """

    def __init__(self, levels: int | None = None):
        self.levels = levels
        self.steps: list[list[bytes]] = []
        self.open: list[list[tuple[bytes, int, int]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.steps)
        self.steps.append([])
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) > ARITY:
            # The run is closed only once a node follows it: alone at the top it may be the root.
            run, self.open[level] = self.open[level][:ARITY], self.open[level][ARITY:]
            self._add(level + 1, self._close(run))

    def _close(self, run: list[tuple[bytes, int, int]]) -> tuple[bytes, int, int]:
        digests = [x[0] for x in run]
        for k, (_, first, end) in enumerate(run):
            step = bytes((k, len(run) - 1 - k)) + b"".join(digests[:k] + digests[k + 1:])
            for leaf in range(first, end):
                self.steps[leaf].append(step)
        return node_of(digests), run[0][1], run[-1][2]

    def finish(self) -> tuple[bytes, list[bytes]]:
        """The root, and the witness of every leaf up to it."""
        level = 0
        while True:
            run = self.open[level]
            top = level + 1 == len(self.open)
            if self.levels == level if self.levels is not None else top and len(run) == 1:
                return run[0][0], [b"".join(x) for x in self.steps]
            self._add(level + 1, self._close(run))
            level += 1


def steps_of(witness: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(witness):
        before, after = witness[at], witness[at + 1]
        digests = [witness[k:k + 32] for k in range(at + 2, at + 2 + 32 * (before + after), 32)]
        yield digests[:before], digests[before:]
        at += 2 + 32 * (before + after)


def proof_of(witness: bytes) -> str:
    """The digest of all siblings, left to right and level by level."""
    return hashlib.sha256("".join(b"".join(a + b).hex() for a, b in steps_of(witness)).encode()).hexdigest()


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf gives with a witness."""
    for before, after in steps_of(witness):
        leaf = node_of([*before, leaf, *after])
    return leaf


def appended(table: pa.Table) -> tuple[bytes, list[bytes], list[int]]:
    """Root and witnesses of a block, in the order of its positions, and that order."""
    order = pc.sort_indices(table["pos"]).to_pylist()
    digests, many = table["digest"].to_pylist(), table["n"][0].as_py() > BLOCK
    block = Appender(LEVELS if many else None)
    for k in order:
        block.append(digests[k])
    root, witnesses = block.finish()
    return root, witnesses, order


def block_root(key: tuple, table: pa.Table) -> pa.Table:
    root, _, _ = appended(table)
    n = table["n"][0].as_py()
    return pa.table({
        "tree": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()),
        "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([root], pa.binary()),
    })


def extended(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The witnesses of a block's nodes, continued by the one of its root."""
    _, witnesses, order = appended(nodes)
    rest = above["witness"][0].as_py()
    return pa.table({
        "tree": pa.array([key[0].as_py()] * len(order), pa.string()),
        "pos": nodes["pos"].take(order).combine_chunks(), "witness": pa.array([x + rest for x in witnesses], pa.binary()),
    })


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"))


def grown(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Nodes, the roots of their blocks, the roots of those, up to one root a tree.

    A round is one table of a 4,096th of the rows before, so two rounds do for 16 million
    leaves a tree and three for 68 billion. Only the largest tree's size reaches the driver.
    """
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        nodes = written(_blocks(nodes).applyInArrow(block_root, NODES), f"{label}-roots")
        rounds.append(nodes)
    return rounds


def _upper(tops: DataFrame, rounds: list[DataFrame], label: str) -> DataFrame:
    """The completed witnesses of the blocks of ``rounds[0]``, from those of the trees' roots."""
    above = tops.select("tree", F.lit(0).cast("long").alias("pos"), "witness")
    for nodes in reversed(rounds[1:-1]):
        above = written(_extend(nodes, above, extended, WITNESSED), f"{label}-witnesses")
    return above


def _extend(nodes: DataFrame, above: DataFrame, how: Callable, schema: str) -> DataFrame:
    return _blocks(nodes).cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(how, schema)


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, from 0 within ``tree`` by ``order``, and ``n``, the tree's rows.

    Sorted by ranges, so that a tree spreads over many tasks, and rows equal in all of
    ``order`` too: the last key just tells input rows apart. Ranks within a range are counted
    in its own task, and the ranges' starts are summed up apart.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_row"]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    cut = placed.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    counted = written(cut.mapInArrow(_count_on, cut.drop("_row").schema.add("_local", "long")), f"{label}-ranges")
    starts = counted.groupBy("tree", "_range").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(
        "tree", "_range", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_here").over(Window.partitionBy("tree")).alias("n")
    )
    joined = counted.join(starts, ["tree", "_range"])
    return joined.select(*rows.columns, (F.col("_start") + F.col("_local")).alias("pos"), "n")


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a range within their tree."""
    tree, at = None, -1
    for batch in batches:
        local, trees = [], batch.column("tree").to_pylist()
        for t in trees:
            at = at + 1 if t == tree else 0
            tree = t
            local.append(at)
        columns = {name: batch.column(name) for name in batch.schema.names if name != "_row"}
        yield pa.RecordBatch.from_pydict(columns | {"_local": pa.array(local, pa.int64())})


def part_of(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs_text: Column | None = None) -> Column:
    parts = [part_of(docs_text if c == "text" and docs_text is not None else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered() -> Column:
    """Which documents the check tampers with; those without an id are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(docs: DataFrame) -> DataFrame:
    """Tree, id, leaf, and the leaf after tampering (null where nothing is tampered with)."""
    changed = F.when(tampered() & F.col("text").rlike("[A-Z]"), leaf_of(lower_ascii(F.col("text"))))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of().alias("digest"), changed.alias("changed"),
    )


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def proven(_: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """A block's rows of the manifest."""
    _, witnesses, order = appended(nodes)
    rest, subroot, root = (above[c][0].as_py() for c in ("witness", "subroot", "root"))
    leaves, changed, ids = (nodes[c].take(order).to_pylist() for c in ("digest", "changed", "doc_id"))
    whole = [x + rest for x in witnesses]
    folded = [fold(b or a, w) for a, b, w in zip(leaves, changed, whole)]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "leaf": [x.hex() for x in leaves], "subroot": [subroot.hex()] * len(ids),
        "root": [root.hex()] * len(ids), "proof_sha256": [proof_of(w) for w in whole],
        "folded_root": [x.hex() for x in folded], "verified": [x == root for x in folded],
    })


def manifest(docs: DataFrame) -> DataFrame:
    """Each row's leaf, the roots above it, its proof, and the root that its (tampered) leaf folds to.

    Null fields hash as ``-``, so null and empty text differ; null languages form a tree of
    their own, the first. A null id comes before all others. Rows of one id are ordered by
    their leaves, so reruns agree; identical rows are leaves of their own, side by side. A
    tree of one row is its leaf. An empty table gives no rows; other columns are not read.
    """
    # Hashed once: the bounds of the ranges take a pass of their own.
    leaves = written(ranked(written(hashed(docs), "hashed"), ["doc_id", "digest"], "leaves"), "leaves")
    rounds = grown(leaves.select("tree", "pos", "n", "digest"), "block")
    subroots = rounds[-1].select("tree", "digest")
    named = written(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "trees"), "trees")
    over = grown(named.select("tree", "pos", "n", "digest"), "tree")
    whole = over[-1].select("tree", F.col("digest").alias("root"))
    ends = over[-1].select("tree", F.unhex(F.lit("")).alias("witness"))
    ways = _extend(over[0], _upper(ends, over, "tree"), extended, WITNESSED).select("pos", "witness")
    tops = named.join(ways, "pos").join(whole, "tree").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "witness"
    )
    tops = written(tops, "tops")
    above = _upper(tops, rounds, "block").join(tops.drop("witness"), "tree")
    return _extend(leaves, above, proven, MANIFEST)
