"""Running totals and neighbours within a key, over ranges, so that a key with very many rows is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

RANGE = "_range"


def ranged(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` as a working table with ``_range``, which grows with (key, order).

    Ranges are cut by a sample of all rows, so one key, or one hour of it, fills as many ranges as its rows
    need. The table is written, so every reader sees the same ranges. Rows equal in key and order share one.
    """
    return written(rows.repartitionByRange(*key, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _same(key: list[str], of: list[str]) -> Column:
    out = F.col(RANGE) == F.col("_of")
    for k, o in zip(key, of, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(o))
    return out


def running_over(cut: DataFrame, key: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None) -> DataFrame:
    """``cut``, as ``ranged`` makes it, with running sums and running maxima of columns within ``key``, by ``order``.

    Totals of a key's ranges are added up first, one row for each, then rows within their range: no window
    holds more of a key than a range.
    """
    sums, highs = sums or {}, highs or {}
    totals = cut.groupBy(*key, RANGE).agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_max_{n}") for n, c in highs.items()))
    earlier = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    of = [f"_key_{k}" for k in key]
    before = totals.select(
        *(F.col(k).alias(o) for k, o in zip(key, of, strict=True)), F.col(RANGE).alias("_of"),
        *(F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in sums), *(F.max(f"_max_{n}").over(earlier).alias(f"_before_{n}") for n in highs),
    )
    within = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(f"_before_{n}", F.lit(0)) + F.sum(c).over(within) for n, c in sums.items()}
    out |= {n: F.greatest(F.col(f"_before_{n}"), F.max(c).over(within)) for n, c in highs.items()}
    return cut.join(before, _same(key, of), "left").withColumns(out).select(*cut.columns, *out)


def running(rows: DataFrame, key: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums and running maxima of columns within ``key``, by ``order``."""
    return running_over(ranged(rows, key, order), key, order, sums, highs).drop(RANGE)


def previous(cut: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``cut``, as ``ranged`` makes it, with the value of the row before within ``key``; null for its first row."""
    last = cut.groupBy(*key, RANGE).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    of = [f"_key_{k}" for k in key]
    earlier = Window.partitionBy(*key).orderBy(RANGE)
    before = last.select(*(F.col(k).alias(o) for k, o in zip(key, of, strict=True)), F.col(RANGE).alias("_of"), F.lag(f"_last.{value}").over(earlier).alias("_before"))
    within = Window.partitionBy(*key, RANGE).orderBy(*order)
    first = F.row_number().over(within) == 1
    joined = cut.join(before, _same(key, of), "left")
    return joined.withColumn(name, F.when(first, F.col("_before")).otherwise(F.lag(value).over(within))).select(*cut.columns, name)
