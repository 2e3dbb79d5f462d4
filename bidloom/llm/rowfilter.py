"""Bloom filters of digests, and choosing rows of a table by decisions about few of them.

A filter is sized from the number of its keys (``BITS_PER_KEY``) and never above ``MAX_BITS``, so
what is broadcast is at most 16 MiB. Beyond some thirteen million keys it fills up: answers stay
exact, as every hit is joined with the keys themselves, and only more rows take that way.

A row is known by its doc_id and a 64-bit hash of its text, so rows that repeat a doc_id with other
texts are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

BITS_PER_KEY = 10
MAX_BITS = 1 << 27
_LEAST_BITS = 1 << 16
#: A key is two longs; each gives the place of its lowest bits and that of its highest 27.
_SHIFTS = (0, 37)


def filter_bits(keys: int) -> int:
    """A power of two from the number of keys, within the bounds."""
    return min(MAX_BITS, max(_LEAST_BITS, 1 << (BITS_PER_KEY * max(keys, 1)).bit_length()))


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of two columns of longs, as 64-bit words: an aggregation, so the driver reads each word once."""
    places = [F.shiftrightunsigned(c, s).bitwiseAND(F.lit(bits - 1)) for c in keys.columns for s in _SHIFTS]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
    found = words.select(F.col("word").cast("int").alias("word"), "set").toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def in_filter(first: np.ndarray, second: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; false is certain."""
    out, mask = np.ones(len(first), bool), np.uint64((len(words) << 6) - 1)
    for keys in (first, second):
        keys = np.ascontiguousarray(keys).view(np.uint64)
        for s in _SHIFTS:
            at = (keys >> np.uint64(s)) & mask
            out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def maybe_in(words: np.ndarray, spark: SparkSession):
    """A function of two long columns: whether the broadcast filter may hold them. Only they go through Python."""
    shared = spark.sparkContext.broadcast(words)

    def maybe(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for first, second in columns:
            yield pa.array(in_filter(first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), shared.value), pa.bool_())

    return F.arrow_udf(maybe, "boolean")


def row_keys() -> list[Column]:
    """The filter keys of a row's identity ``(id, hash)``."""
    return [F.xxhash64("id", "hash").alias("first"), F.xxhash64("hash", "id").alias("second")]


def text_hash() -> Column:
    """The part of a row's identity that comes from its text."""
    return F.xxhash64("text")


def chosen_rows(docs: DataFrame, decided: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``decided(id, hash, stays)`` has a row for every row of ``docs``. A row that repeats both
    doc_id and text comes back once: the least by its other columns, or any where a type has no
    order. Rows that the filter of the others lacks are not shuffled.
    """
    about = decided.groupBy("id", "hash").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1")
    about = scratch.table(about.select("id", "hash", "stays"), "decided")
    n = about.count()
    if not n:
        return docs
    maybe = maybe_in(filter_of(about.select(*row_keys()), filter_bits(n)), docs.sparkSession)
    about = about.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "stays")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_hash().alias("hash"))
    probed = rows.withColumn("maybe", maybe(*row_keys()))
    one = F.first if any(t in docs.schema.simpleString() for t in ("map<", "variant")) else F.min
    met = probed.where("maybe").groupBy("id", "hash").agg(one("row").alias("row"))  # repeated rows are one before the shuffle
    met = met.join(about, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left").where("coalesce(stays, true)")
    return probed.where("NOT maybe").select("row").union(met.select("row")).select("row.*")
