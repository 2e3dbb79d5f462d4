"""Names that hold a fragment, through their substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Substrings that one task takes names apart into: their counts stay in memory.
TASK = 2_000_000


def grams(text: Column, size: Column) -> Column:
    """Distinct substrings of ``size`` characters."""
    n = F.length(text)
    at = F.when((n >= size) & (size > 0), F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))


def hint_of(stem: Column, prefix: str = "NOTIF_") -> Column:
    """The distinctive fragment of a labelled stem: what stands before the first underscore, without the prefix."""
    return F.substring_index(F.replace(stem, F.lit(prefix), F.lit("")), "_", 1)


def unique_holder(fragments: DataFrame, names: DataFrame, q: int = 3) -> DataFrame:
    """``(fragment, holders, name)`` of the distinct ``fragments(fragment)``; ``name`` is null unless one name alone holds it.

    ``names(name)``; letter case does not count, equal names are one, null names and fragments are left out. Names are
    taken apart into the substrings of the lengths that fragments have, these are counted, and a fragment meets the
    count of its own text: no fragment meets a name, so the work grows with names and fragments, not with their
    pairs. The empty fragment is in every name. ``q`` changes nothing: every length is a gram.
    """
    known = written(names.where("name IS NOT NULL").select("name").distinct().withColumn("low", F.lower("name")), "names")
    asked = written(fragments.where("fragment IS NOT NULL").select("fragment").distinct().withColumn("low", F.lower("fragment")), "fragments")
    sizes = sorted(r["size"] for r in asked.select(F.length("low").alias("size")).distinct().collect())  # a number for each length
    sums = F.sum(sum((F.greatest(F.length("low") - s + 1, F.lit(0)) for s in sizes), F.lit(0)).cast("long"))
    parts = -(-(known.agg(sums.alias("n")).first()["n"] or 0) // TASK)
    each = known.repartition(max(1, parts)).withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))) if sizes else known.limit(0).withColumn("size", F.lit(0))
    held = each.where(F.col("size") <= F.length("low")).select("name", F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(grams(F.col("low"), F.col("size")))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    met = asked.join(counts, F.col("low") == F.col("gram"), "left")
    return met.select("fragment", F.coalesce("n", F.lit(0)).alias("holders"), F.when(F.col("n") == 1, F.col("first")).alias("name"))


def resolve_stems(stems: DataFrame, exact: DataFrame, names: DataFrame, q: int = 3, prefix: str = "NOTIF_") -> DataFrame:
    """``stems(stem, ...)`` with ``name``: that of the file of the same stem, or else the one name that holds its hint.

    ``exact(stem, name)`` has a stem once.
    """
    left = stems.join(exact.withColumnRenamed("name", "_exact"), "stem", "left")
    found = unique_holder(left.where("_exact IS NULL").select(hint_of(F.col("stem"), prefix).alias("fragment")), names, q)
    return left.join(found.select(F.col("fragment").alias("_hint"), F.col("name").alias("_loose")), hint_of(F.col("stem"), prefix) == F.col("_hint"), "left").select(
        *stems.columns, F.coalesce("_exact", F.when(F.col("_exact").isNull(), F.col("_loose"))).alias("name")
    )
