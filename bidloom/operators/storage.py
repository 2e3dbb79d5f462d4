"""Writes that keep keys unique: upserts, caches and merges, as new versions of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], created_at: str, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``old`` replaced by the newest row of ``new`` of the same key, others kept.

    Columns in ``carry`` keep the oldest stored value. Both sides are reduced to one row per key by
    aggregation, so repeated keys are no problem.
    """
    rest = [c for c in old.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*rest), created_at).alias("n"))
    first = old.groupBy(*key).agg(F.min_by(F.struct(*rest), created_at).alias("o"))
    both = first.join(last, key, "full_outer")
    value = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in (carry or []) else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*key, *(value(c).alias(c) for c in rest))


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored, the first of each key."""
    rest = [c for c in new.columns if c not in key]
    fresh = new.join(old.select(*key), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Requests with the cached payload and whether it was a hit."""
    return requests.join(cache, key, "left").withColumn("hit", F.col("payload").isNotNull())


def merge_tracking(old: DataFrame, new: DataFrame, key: str, owned: Column, keep: list[str]) -> DataFrame:
    """A tracking table merged by key over the union of both sides' columns.

    Old rows that ``owned`` selects are replaced as a whole, so one absent from ``new`` goes; other
    old rows stay. Columns in ``keep`` keep their old value where the new side has none.
    """
    columns = [key, *[c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]]
    stays = old.where(~owned).join(new.select(key), key, "left_anti")
    kept = [c for c in keep if c in old.columns]
    before = old.select(key, *(F.col(c).alias(f"_{c}") for c in kept))
    fresh = new.join(before, key, "left")
    for c in kept:
        fresh = fresh.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")) if c in new.columns else F.col(f"_{c}"))
    return stays.unionByName(fresh.drop(*(f"_{c}" for c in kept)), allowMissingColumns=True).select(*columns)


def once_per_text(rows: DataFrame, text: str) -> DataFrame:
    """Each distinct text with its digest: what an expensive function has to see."""
    return rows.select(F.sha2(text, 256).alias("digest"), text).dropDuplicates(["digest"])


def changed(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """Rows whose derived value is no longer the stored one; nulls are values."""
    return rows.where(~old.eqNullSafe(new))
