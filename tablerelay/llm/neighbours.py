"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every vector by three rounds of random signs and a fast Hadamard transform, and
its bucket is the axis, with sign, that the vector is then nearest to. Vectors lie in one
bucket of each table; a query also looks into those of the next nearest axes. A bucket's
queries and candidates meet in tiles of bounded size, where the cosines are computed exactly
and each query keeps its best; the best of all tiles are ranked at the end. Pairs are never
written or shuffled, only the few best of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.llm.common import written

#: Tables, and buckets of each that a query looks into.
TABLES, PROBES = 8, 12
#: Queries and candidates of a tile: what one Python task holds at a time.
TILE_QUERIES, TILE_CANDIDATES = 2048, 16_384
#: Scores this near the last place are compared again, digit for digit.
SLACK = 1e-9

CODED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("dim", T.IntegerType()),
    T.StructField("table", T.IntegerType()), T.StructField("code", T.IntegerType()),
])
BUCKET, TILE = ["dim", "table", "code"], ["dim", "table", "code", "of_queries", "of_candidates"]
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, all components there and finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def turned(vectors: np.ndarray, table: int) -> np.ndarray:
    """The unit vectors after the table's pseudo-rotation, padded to a power of two."""
    n, dim = vectors.shape
    width = 1 << (dim - 1).bit_length()
    x = np.zeros((n, width))
    x[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([table, width]).integers(0, 2, (3, width)) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s) / np.sqrt(width)
    return x


def codes(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 a for axis a, 2 a + 1 for its opposite."""
    x = turned(vectors, table)
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, both.shape[1])]


def coded(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row for each bucket that a vector (``id``, ``vector``) is looked for in.

    Vectors travel in the precision they came in, which the bytes of a row tell by ``dim``.
    """
    kind = np.float32 if rows.schema["vector"].dataType.elementType == T.FloatType() else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for dim in sorted({len(x) for x in lists}):
                some = [k for k, x in enumerate(lists) if len(x) == dim]
                vectors = np.array([lists[k] for k in some], dtype=np.float64)
                raw = [v.tobytes() for v in vectors.astype(kind)]
                for table in range(tables):
                    found = codes(vectors, table, probes)
                    n = found.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[some], n), pa.int64()), pa.array([r for r in raw for _ in range(n)], pa.binary()),
                        pa.array(np.full(len(some) * n, dim), pa.int32()), pa.array(np.full(len(some) * n, table), pa.int32()),
                        pa.array(found.ravel().astype(np.int32)),
                    ], names=CODED.names)

    return rows.select("id", "vector").mapInArrow(run, CODED)


def best_of_tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query its ``k`` best candidates but itself, ties to the smaller id."""
    out_q, out_c, out_s = [], [], []
    if len(queries) and len(candidates):
        q, c = _doubles(queries), _doubles(candidates)
        ids, q_norm, c_norm = candidates["id"].to_numpy(), _norm(q), _norm(c)
        for i in range(0, len(q), 256):
            near = (q[i:i + 256] @ c.T) / q_norm[i:i + 256, None] / c_norm
            for row, query in enumerate(queries["id"].to_numpy()[i:i + 256]):
                mine = near[row]
                mine[ids == query] = -np.inf
                floor = -2.0
                n = min(k, len(mine))
                while True:  # equal ids count once, so more than k places may be needed
                    floor = np.partition(mine, len(mine) - n)[len(mine) - n] - SLACK
                    at = np.flatnonzero((mine >= floor) & (ids != query))
                    if len(np.unique(ids[at])) >= k or n == len(mine):
                        break
                    n = min(4 * n, len(mine))
                exact = (c[at] * q[i + row]).sum(axis=1) / (q_norm[i + row] * c_norm[at])
                order, seen = np.lexsort((ids[at], -exact)), set()
                for j in order:
                    if ids[at[j]] not in seen:
                        seen.add(ids[at[j]])
                        out_q.append(query), out_c.append(ids[at[j]]), out_s.append(exact[j])
                        if len(seen) == k:
                            break
    return pd.DataFrame({"query_id": np.array(out_q, dtype=np.int64), "vec_id": np.array(out_c, dtype=np.int64), "score": np.array(out_s, dtype=np.float64)})


def _doubles(rows: pd.DataFrame) -> np.ndarray:
    dim = int(rows["dim"].iloc[0])
    kind = np.float32 if len(rows["vector"].iloc[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(rows["vector"]), dtype=kind).reshape(-1, dim).astype(np.float64)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The best of every tile, for queries and candidates with their buckets."""
    sizes = queries.groupBy(*BUCKET).agg(F.ceil(F.count("*") / TILE_QUERIES).alias("query_tiles")).join(
        candidates.groupBy(*BUCKET).agg(F.ceil(F.count("*") / TILE_CANDIDATES).alias("candidate_tiles")), BUCKET
    )
    # A row for each bucket: twice the padded dimensions times the tables, whatever the data.
    sizes = written(sizes, "ann-buckets")

    def dealt(rows: DataFrame, own: str, tiles: str, other: str, other_tiles: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(tiles)).cast("long").alias(own)
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_tiles) - 1)).alias(other)
        return rows.join(sizes, BUCKET).select(*BUCKET, "id", "vector", mine, all_)

    left = dealt(queries, "of_queries", "query_tiles", "of_candidates", "candidate_tiles").groupBy(*TILE)
    right = dealt(candidates, "of_candidates", "candidate_tiles", "of_queries", "query_tiles").groupBy(*TILE)
    return left.cogroup(right).applyInPandas(lambda a, b: best_of_tile(a, b, k), FOUND)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, tables: int = TABLES, probes: int = PROBES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine) of each query's ``k`` nearest.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
    rows without an id; vectors of different lengths are never compared. Rows that share an id
    count as one, at the best score, and a query isn't its own neighbour. A query whose buckets
    hold fewer than ``k`` is compared with all rows, so it has ``k`` where there are so many.
    """
    given = vectors.schema[vector].dataType
    kind = "array<float>" if given == T.ArrayType(T.FloatType(), given.containsNull) else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"), is_query.alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = F.coalesce(F.col("query"), F.lit(False))
    queries, candidates = written(coded(rows.filter(asked), tables, probes), "ann-queries"), coded(rows, tables, 1)
    found = written(_met(queries, candidates, k), "ann-found")
    counts = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k)
    short = written(
        queries.filter("table = 0").select("id", "vector", "dim").distinct().join(counts, F.col("id") == F.col("query_id"), "left_anti"), "ann-short"
    )
    if not short.isEmpty():
        everywhere = lambda df: df.withColumns({"table": F.lit(-1), "code": F.lit(0)})
        found = found.unionByName(_met(everywhere(short), everywhere(candidates.filter("table = 0")), k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
