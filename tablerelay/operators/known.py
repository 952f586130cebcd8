"""Ids known already, kept as Bloom filters: a few bits an id instead of the ids.

A filter is a table of 64-bit words with the bits of its ids. It is stored by the day on which
ids were added; whether an id may be known is asked of all days kept, word by word, so that only
the words an id needs are joined and no filter is held whole. What a filter denies is new for
sure; the rest, with one in a hundred of the new ones, has to meet the ids themselves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.operators.keys import quoted

#: Bits of a filter, as a power of two, and of an id: ten bits an id for 13 million ids.
LOG_BITS, HASHES = 27, 7


def _places(key: Column, log_bits: int) -> Column:
    """The distinct bits of an id, taken as text: so it may have another type in another table."""
    each = [F.pmod(F.xxhash64(F.lit(k), key.cast("string")), F.lit(1 << log_bits)) for k in range(HASHES)]
    return F.array_distinct(F.array(*each))


def id_filter(ids: DataFrame, key: str, log_bits: int = LOG_BITS) -> DataFrame:
    """``word`` and ``bits`` of the ids in a column; nulls are no ids. Reduced before its shuffle."""
    places = ids.where(F.col(quoted(key)).isNotNull()).select(F.explode(_places(F.col(quoted(key)), log_bits)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    return places.groupBy((F.col("at") / 64).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))


def add_known(ids: DataFrame, key: str, path: str, day: str | dt.date, log_bits: int = LOG_BITS) -> None:
    """Store the filter of the ids added on a day; a repeated run replaces it."""
    words = id_filter(ids, key, log_bits).withColumn("day", F.lit(str(day)))
    words.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word bigint, bits bigint, day string").parquet(path)


def maybe_known(rows: DataFrame, key: str, known: DataFrame, log_bits: int = LOG_BITS) -> DataFrame:
    """The distinct ids of ``rows`` that the filters may hold: all that are known, few others."""
    ids = rows.select(F.col(quoted(key)).alias("id")).where("id IS NOT NULL").distinct()
    wanted = ids.select("id", F.explode(_places(F.col("id"), log_bits)).alias("at")).select(
        "id", (F.col("at") / 64).cast("bigint").alias("word"), (F.col("at") % 64).cast("int").alias("bit")
    )
    # Days share words: the bits of all of them count together.
    words = known.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = wanted.join(words, "word", "left").withColumn("has", F.coalesce(F.getbit("bits", F.col("bit")), F.lit(0)))
    return found.groupBy("id").agg(F.min("has").alias("has")).where("has = 1").select(F.col("id").alias(key))
