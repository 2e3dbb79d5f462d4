"""Interaction of filters, for every subset and every order of them.

Each document gets a mask with one bit per filter that it fails. Counts per part and mask, with the
counts of good and of toxic documents beside them, are all that is kept of the table: at most
``2 ** k`` rows a part. The subset-zeta transform makes of them, for every set of masks' bits, the sum
over all its subsets: one step per bit, in which each entry with the bit adds the entry without it.
Documents that survive the filters S are those whose mask lies in the complement of S, so all ``2 ** k``
subsets are answered by one array. A step of an order is then the difference between the survivors of
two neighbouring subsets, and a filter's share over all orders a sum of such differences, weighted by
the number of orders in which they occur.

Texts are read once and leave the scan as a mask and a digest. A document fails the duplicate filter
if its text has a smaller doc_id somewhere in the table: the least doc_id of each digest is aggregated before the
shuffle and joined back by (digest, doc_id), so copies of one text, however many, spread over all tasks.
Equal SHA-256 digests stand for equal texts.

Cases. A null text is an empty one, a null part the empty string. A row without a doc_id is in no order with others:
it neither fails the duplicate filter nor makes others fail it, and carries no label. Repeated rows of a
doc_id count once each, and none of them is smaller than another; of several labels of a doc_id the
largest counts, null ones do not. A very long text is one row like any other. An empty table has no parts and gives no
rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
#: Filters that a text fails by itself, in the order of their bits; the bit after theirs is that of duplicates.
TEXT_FILTERS = ("A", "B", "C", "D")
DUPLICATE = "E"
#: Orders of seven filters are 5,040 a part.
MOST_FILTERS = 7
MEASURES = ("n", "good", "toxic")


def text_failures() -> dict[str, Column]:
    """The failure conditions of the columns ``text`` (no null) and ``w``, its words."""
    return {
        "A": F.size("w") < 100,
        "B": 100 * F.size(F.array_distinct("w")) < 80 * F.size("w"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, part: str) -> DataFrame:
    """``(doc_id, part, mask, digest)`` of every row of ``docs``: the bits of ``TEXT_FILTERS`` and the text's digest."""
    whole = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = whole.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    tests, mask = text_failures(), F.lit(0)
    for bit, name in enumerate(TEXT_FILTERS):
        mask = mask + F.when(tests[name], 1 << bit).otherwise(0)
    return words.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def with_duplicates(masks: DataFrame, scratch: Scratch) -> DataFrame:
    """``masks`` with the next bit set where a smaller doc_id has the same digest. ``masks`` is read twice."""
    least = masks.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("least"))
    least = scratch.table(least, "least")  # so that rows repeated very often can be split in the join
    fails = F.col("doc_id").isNotNull() & F.col("least").isNull()
    return masks.join(least, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(fails, 1 << len(TEXT_FILTERS)).otherwise(0)).drop("least")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part and mask, and how many of them have these labels."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    rows = masks.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in ("good", "toxic")))


def subset_survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """``(part, survivors)``: an array over all subsets S of the filters, as bits, with the counts of those that pass all of S."""
    full = 1 << n_filters
    entry = F.struct("mask", F.struct(*MEASURES).alias("c"))
    none = F.struct(*(F.lit(0).cast("long").alias(m) for m in MEASURES))
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("seen"))  # 2 ** n_filters entries at most
    table = by_part.select("part", F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda m: F.coalesce(F.col("seen")[m], none)).alias("z"))

    def with_bit(bit: int):
        def added(x: Column, i: Column) -> Column:
            other = F.get("z", i.bitwiseXOR(F.lit(bit)))
            return F.when(i.bitwiseAND(F.lit(bit)) != 0, F.struct(*((x[m] + other[m]).alias(m) for m in MEASURES))).otherwise(x)

        return F.transform("z", added).alias("z")

    for b in range(n_filters):
        table = table.select("part", with_bit(1 << b))
    return table.select("part", F.transform("z", lambda x, i: F.get("z", F.lit(full - 1) - i)).alias("survivors"))


def order_steps(survivors: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets.

    ``names`` has a letter per filter, in the order of the bits; there are at most ``MOST_FILTERS``.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"orders of {k} filters")
    all_of = (1 << k) - 1

    def at(subset: Column | int) -> Column:
        return F.get("survivors", F.lit(subset) if isinstance(subset, int) else subset)

    def over_all_orders(bit: int) -> Column:
        """What the filter removes, summed over all orders: each subset stands before it in |S|! (k - 1 - |S|)! of them."""
        out = F.lit(0).cast("long")
        for s in range(1 << k):
            if not s & bit:
                size = s.bit_count()
                out = out + (at(s)["n"] - at(s | bit)["n"]) * (factorial(size) * factorial(k - 1 - size))
        return out

    filters = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"), F.lit(1 << b).alias("bit"), (at(0)["n"] - at(1 << b)["n"]).alias("failing"),
                (at(all_of ^ (1 << b))["n"] - at(all_of)["n"]).alias("alone"), over_all_orders(1 << b).alias("shapley"),
            )
            for b, name in enumerate(names)
        )
    )
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = survivors.withColumn("filters", filters).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    here = F.get("filters", F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = F.lit(0)
    for b, name in enumerate(names):
        before = before + F.when(F.instr(earlier, F.lit(name)) > 0, 1 << b).otherwise(0)
    steps = steps.withColumn("here", here).withColumn("before", before)
    steps = steps.withColumn("was", at(F.col("before"))).withColumn("is", at(F.col("before") + F.col("here.bit")))
    removed = F.col("was.n") - F.col("is.n")
    return steps.select(
        "part", "filter_order", "step", F.col("is.n").alias("kept"), removed.alias("removed"), (F.col("here.failing") - removed).alias("redundant"),
        F.col("here.alone").alias("unique_fails"), (F.col("was.good") - F.col("is.good")).alias("good_lost"), (F.col("was.toxic") - F.col("is.toxic")).alias("toxic_lost"),
        F.col("here.shapley").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "lang") -> DataFrame:
    """Every step of every order of the five filters, for each value of ``part`` of ``docs(doc_id, text, ...)``."""
    masks = with_duplicates(scratch.table(failure_masks(docs, part), "masks"), scratch)
    counts = scratch.table(mask_counts(masks, labels), "mask-counts")
    names = "".join(TEXT_FILTERS) + DUPLICATE
    return order_steps(subset_survivors(counts, len(names)), names)
