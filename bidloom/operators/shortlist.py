"""Shortlists without arbitrary tie-breaking, tolerant of missing facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The factors, and whether less is better.
FACTORS: dict[str, bool] = {"experience": False, "project_scale": False, "technical_approach": False, "pricing": True}


def rank_normalise(values: DataFrame, pool: list[str], column: str, lower_is_better: bool = False) -> DataFrame:
    """``(*pool, column, signal)``: the dense rank of each distinct value, scaled to [0, 1].

    One distinct value gives 1. Only distinct values are ranked, so what meets in a task is not the
    rows of a pool but its distinct values.
    """
    window = Window.partitionBy(*pool)
    d = values.where(F.col(column).isNotNull()).select(*pool, column).distinct()
    d = d.withColumn("place", F.row_number().over(window.orderBy(column))).withColumn("last", F.count("*").over(window))
    scaled = (F.col("place") - 1) / F.nullif(F.col("last") - 1, F.lit(0))
    return d.select(*pool, column, F.when(F.col("last") == 1, 1.0).otherwise((1 - scaled) if lower_is_better else scaled).alias("signal"))


def active_weights(weights: dict[str, float]) -> dict[str, float]:
    """Known factors of positive weight; all factors at 1 when there are none."""
    return {k: float(v) for k, v in weights.items() if k in FACTORS and v > 0} or dict.fromkeys(FACTORS, 1.0)


def score(candidates: DataFrame, weights: dict[str, float], pool: list[str]) -> DataFrame:
    """Candidates with ``score``, the weighted mean of the factors they have, and ``scored_on``."""
    active = active_weights(weights)
    out = candidates
    for f in active:
        ranks = rank_normalise(candidates, pool, f, FACTORS[f]).withColumnRenamed("signal", f"signal_{f}")
        out = out.join(ranks, [*pool, f], "left")
    total = sum((F.when(F.col(f"signal_{f}").isNotNull(), w * F.col(f"signal_{f}")).otherwise(0.0) for f, w in active.items()), F.lit(0.0))
    weight = sum((F.when(F.col(f"signal_{f}").isNotNull(), F.lit(w)).otherwise(0.0) for f, w in active.items()), F.lit(0.0))
    scored_on = F.array_compact(F.array(*(F.when(F.col(f"signal_{f}").isNotNull(), F.lit(f)) for f in sorted(active))))
    return out.withColumn("score", F.when(weight > 0, total / weight)).withColumn("scored_on", scored_on)


def shortlist(scored: DataFrame, count: int, pool: list[str], vendor: str = "vendor_id", places: int = 9) -> DataFrame:
    """The best ``count`` of each pool and all that tie with the last of them.

    Without a score a candidate sorts last and never ties. ``tied_at_cutoff`` marks those that share
    the last score where that brought in more than ``count``.
    """
    out = scored.withColumn("_s", F.round("score", places))
    order = Window.partitionBy(*pool).orderBy(F.col("_s").desc_nulls_last(), F.col(vendor))
    by_score = Window.partitionBy(*pool).orderBy(F.col("_s").desc_nulls_last())
    out = out.withColumn("_n", F.row_number().over(order)).withColumn("_r", F.rank().over(by_score))
    kept = out.where((F.col("_n") <= count) | (F.col("_s").isNotNull() & (F.col("_r") <= count)))
    all_ = Window.partitionBy(*pool)
    cut = F.max(F.when(F.col("_n") == count, F.col("_s"))).over(all_)
    more = F.max(F.when(F.col("_n") > count, True)).over(all_)
    return kept.withColumn("tied_at_cutoff", F.coalesce(more & (F.col("_s") == cut), F.lit(False))).drop("_s", "_n", "_r")


def basis(scored_on: Column, wanted: int) -> Column:
    n = F.size(scored_on)
    return (
        F.when(n == 0, "Not scored: none of the requested factors could be read; for manual review.")
        .when(n < wanted, F.format_string("Scored on %d of %d requested factors.", n, F.lit(wanted)))
        .otherwise(F.format_string("Scored on all %d requested factors.", F.lit(wanted)))
    )
