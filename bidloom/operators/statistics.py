"""Statistics of small samples, as column expressions and small aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """``struct(low, high)`` of the Wilson interval; (0, 1) without trials."""
    k, m = successes.cast("double"), n.cast("double")
    p = k / m
    scale = 1 + z * z / m
    middle = (p + z * z / (2 * m)) / scale
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / scale
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high"))).otherwise(
        F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    )


def sign_test(better: Column, worse: Column) -> Column:
    """Exact two-sided binomial p of discordant pairs; 1 without any."""
    n, k = better + worse, F.least(better, worse)
    # C(n, i) / 2**n term by term in logarithms, so large n does not overflow.
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(i > 0, F.log((n - i + j) / j)).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often b is above, below and equal to a."""
    return pairs.agg(F.count_if(F.col(b) > F.col(a)).alias("improved"), F.count_if(F.col(b) < F.col(a)).alias("regressed"), F.count_if(F.col(b) == F.col(a)).alias("tied"))


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters over one table; 0 without rows, 1 or 0 when chance is certain."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    columns = cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "a").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("products"))
    t = F.col("total").cast("double")
    po, pe = F.col("agree") / t, F.coalesce("products", F.lit(0.0)) / (t * t)
    value = F.when(F.coalesce("total", F.lit(0)) == 0, 0.0).when(pe >= 1.0, F.when(po >= 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(chance).select(F.col("total").alias("n"), po.alias("observed"), pe.alias("expected"), value.alias("kappa"))


def kappa_band(k: Column) -> Column:
    return F.when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")


def bootstrap_mean(values: DataFrame, column: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean of paired differences with a percentile interval and two-sided p.

    Poisson bootstrap: each resample gives a row a Poisson(1) weight, so the rows of one distinct
    value together have a Poisson weight of their number, drawn at once from a generator seeded by
    the value. A task hands on its sums, one row per resample.
    """

    def run(batches):
        weights, sums, seen = np.zeros(resamples), np.zeros(resamples), False
        for batch in batches:
            for v, times, key in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                w = np.random.default_rng([seed, key & (1 << 64) - 1]).poisson(times, resamples)
                weights, sums, seen = weights + w, sums + w * v, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weights), pa.array(sums)], ["resample", "w", "s"])

    rows = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("times"))
    drawn = rows.select("v", "times", F.xxhash64("v")).mapInArrow(run, "resample long, w double, s double")
    means = drawn.groupBy("resample").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    spread = means.agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), (2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p")
    )
    return values.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean")).crossJoin(spread).select(
        "mean", F.coalesce(F.get("q", 0), F.lit(0.0)).alias("low"), F.coalesce(F.get("q", 1), F.lit(0.0)).alias("high"), F.least(F.lit(1.0), F.coalesce("p", F.lit(1.0))).alias("p")
    )


def confusion(rows: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives with precision, recall, F1 and accuracy."""
    a, p = F.col(actual), F.col(predicted)
    counts = [F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn")]
    out = rows.groupBy(*(by or [])).agg(*counts)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumns(
        {
            "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        }
    )


def significance(p: Column, alpha: float = 0.05) -> Column:
    """What a p says at a level, in words."""
    return F.when(p < alpha, f"significant at {alpha:g}").when(p.isNotNull(), f"NOT significant at {alpha:g}")


def p_text(p: Column, resamples: int | None = None) -> Column:
    """A p to four places, or as below the least that so many resamples can tell."""
    shown = F.concat(F.lit("p="), F.format_string("%.4f", F.bround(F.round(p, 12), 4)))
    return shown if not resamples else F.when(p < 1.0 / resamples, F.lit(f"p<{1.0 / resamples:.4f}")).otherwise(shown)


def sign_test_text(improved: Column, regressed: Column, tied: Column) -> Column:
    """Paired counts with the exact p and what it says; ties are named where there are any."""
    p = sign_test(improved, regressed)
    ties = F.when(tied > 0, F.concat(F.lit(" / "), tied.cast("string"), F.lit(" tied"))).otherwise("")
    return F.concat(improved.cast("string"), F.lit(" improved / "), regressed.cast("string"), F.lit(" regressed"), ties, F.lit(", "), p_text(p), F.lit(", "), significance(p))


def label_units(keys: DataFrame, dimension: str) -> DataFrame:
    """``(id, notification_id, open_this, label)`` of the bids that a second rater judges, without the labels that are there.

    ``keys(vendor_id, notification_id, file_name, intended_status, ...)``. Only an eliminated bid has a ground.
    """
    asked = keys if dimension != "ground" else keys.where("intended_status = 'eliminate'")
    return asked.select(F.col("vendor_id").alias("id"), "notification_id", F.col("file_name").alias("open_this"), F.lit("").alias("label"))


def committed_labels(keys: DataFrame, dimension: str) -> DataFrame:
    """``(id, label)``: the labels of a dimension (status or ground) that the answer key has."""
    asked = keys if dimension != "ground" else keys.where("intended_status = 'eliminate'")
    return asked.select(F.col("vendor_id").alias("id"), F.col(f"intended_{dimension}").alias("label"))
