"""What the operators of this package share: a written table, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the contracts: words are runs of other than these six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Bytes of text that a Python task works on at a time.
PIECE = 4_000_000

_own_folder: str | None = None


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared place that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local, as in tests, one is made.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folder = base = _own_folder or tempfile.mkdtemp(prefix="tablerelay-llm-")
    return f"{base.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once into the shared folder and read back.

    Cuts the lineage: a lost executor costs tasks, never what came before the table.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def word_count(text: Column) -> Column:
    """How many words a text has; null has none. A word becomes one letter, white space goes."""
    letters = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "a"), ASCII_SPACE, "")
    return F.length(letters).cast("long")


def components(edges: DataFrame, a: str, b: str, label: str, rounds: int = 60) -> DataFrame:
    """Node and smallest node of its connected component, for the nodes of ``edges``.

    Alternates large and small stars over integer nodes: every round hangs the neighbours of
    a node below the smallest of them, so edges never grow in number, and the rounds grow with
    the logarithm of the longest chain. Each round is one table in the shared folder. A hot
    node's smallest neighbour is found by a partial aggregation and joined back, so that no
    neighbour list is held whole. Ends when a round changes nothing; ``rounds`` only guards
    against a fault and raises.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{label}-edges"
    )
    before = _state(now)
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        now = written(small, f"{label}-stars")
        after = _state(now)
        if after == before:
            least_of = now.groupBy("u").agg(F.min("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return least_of.select(F.col("u").alias("node"), "component").unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges: two rows of numbers, whatever the size."""
    mixed = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 40))).first()
    return tuple(row)


def add_columns(docs: DataFrame, text: str, added: T.StructType, make: Callable[[], Callable], piece: int = PIECE) -> DataFrame:
    """``docs`` with columns computed from the texts in Arrow batches.

    ``make()`` is called once a task and gives a function from a list of texts (or None) to a
    list of columns. A batch is worked on in slices of about ``piece`` characters, so memory
    follows the longest text, not the batch. Columns that already have an added name go.
    """
    names = set(added.names)
    stay = [c for c in docs.columns if c not in names]
    # By position: names may hold dots, which Spark's Arrow maps don't take.
    given = docs.select(F.col(quoted(text)).alias("c0"), *(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(stay, start=1)))
    fields = [T.StructField(f"c{k}", given.schema[f"c{k}"].dataType) for k in range(1, len(stay) + 1)]
    schema = T.StructType(fields + [T.StructField(f"a{k}", f.dataType) for k, f in enumerate(added.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in _slices(batch, 0, piece):
                work = work or make()
                yield pa.RecordBatch.from_arrays(part.columns[1:] + work(part.column(0).to_pylist()), names=schema.names)

    return given.mapInArrow(run, schema).toDF(*stay, *added.names)


def _slices(batch: pa.RecordBatch, at: int, piece: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // piece
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
