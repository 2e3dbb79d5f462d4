"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation many times: after each turn, the turns so far. A rolling hash
gives each turn the hash of the turns up to it, so a conversation that is a prefix of a longer one
ends in a hash that the longer one has before its end. An anti-join against these inner hashes
keeps the maximal conversations; of equal ones the smallest conv_id stays. These are rendered.

The hash of a prefix is the sum of the hashes of (place, role, text) of its turns, kept as four
sums of 32-bit halves of two 64-bit hashes. Prefixes count as equal when their length and these 128
bits are; their bytes are not compared. A sum can be taken piecewise: turns are dealt by ranges
of (conv_id, turn), summed within a partition and shifted by the totals of earlier partitions. A
conversation that fills many partitions therefore never meets in one task, and the shifts number
at most one row per partition and conversation that crosses its edge. The same sums give each
turn's place and its offset in the rendered text, which is returned turn by turn.

Cases. Turns are ordered by (turn, role, text), nulls first; repeated rows count as turns of their
own. Null role and text render as empty. Rows of a null conv_id are one conversation. A very long turn is
one row, of which only hashes and lengths move until it is rendered. Ties: of equal conversations the smallest conv_id
stays, a null one last. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SUMS = ["a", "b", "c", "d"]


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def _halves(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)


def running(rows: DataFrame, scratch: Scratch, key: str, order: list[str], sums: dict[str, Column], place: str = "place") -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its running total within ``key``, by ``order``.

    ``place`` becomes the row's number within its key, from 1, before ``sums`` are evaluated, so
    they may use it. A prefix sum in two levels: within range partitions, then across them.
    """
    dealt = rows.repartitionByRange(F.col(key), *[F.col(o) for o in order]).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, "dealt")
    within = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def shifted(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
        # One row per key and partition; only a key that crosses partitions needs a shift.
        local = df.groupBy(key, "part").agg(*(F.sum(v).alias(f"total_{n}") for n, v in totals.items()))
        crossing = local.groupBy(key).agg(F.count("*").alias("spans")).where("spans > 1").select(F.col(key).alias("cross"))
        shifts = local.join(crossing, F.col(key).eqNullSafe(F.col("cross")), "left_semi").select(
            F.col(key).alias("k"), F.col("part").alias("p"), *(F.coalesce(F.sum(f"total_{n}").over(earlier), F.lit(0)).alias(f"shift_{n}") for n in totals)
        )
        out = df.join(shifts, F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left").drop("k", "p")
        return out

    one = {place: F.lit(1).cast("long")}
    numbered = shifted(dealt, one).withColumn(place, F.count("*").over(within) + F.coalesce(f"shift_{place}", F.lit(0))).drop(f"shift_{place}")
    numbered = numbered.withColumns(sums)
    numbered = scratch.table(numbered, "numbered")
    out = shifted(numbered, {n: F.col(n) for n in sums})
    out = out.withColumns({n: F.sum(n).over(within) + F.coalesce(f"shift_{n}", F.lit(0)) for n in sums})
    return out.drop("part", *(f"shift_{n}" for n in sums))


def maximal_conversations(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns of the maximal conversations with their rendering.

    ``(conv_id, place, turns, role, text, rendered, starts_at, prefix_hash)``: ``place`` from 1,
    ``starts_at`` the offset in code points of ``rendered`` in the conversation's text.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    first, second = (F.xxhash64(F.lit(seed), F.col("place"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))) for seed in (11, 12))
    (a, b), (c, d) = _halves(first), _halves(second)
    length = F.length(render_turn(F.col("role"), F.col("text"))).cast("long")
    hashed = scratch.table(running(turns, scratch, "conv_id", ["turn", "role", "text"], {"a": a, "b": b, "c": c, "d": d, "ends_at": length}), "hashed")

    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("place", *SUMS)).alias("end")).select("conv_id", F.col("end.place").alias("turns"), *(F.col(f"end.{s}").alias(s) for s in SUMS))
    # conv_id NULL is a conversation too, so equal ones are told apart by a struct, which orders nulls first.
    ends = ends.groupBy("turns", *SUMS).agg(F.min(F.struct("conv_id")).alias("who")).select(F.col("who.conv_id").alias("conv_id"), "turns", *SUMS)
    inner = hashed.select("conv_id", F.col("place").alias("turns"), *SUMS).join(
        hashed.groupBy("conv_id").agg(F.max("place").alias("last")).select(F.col("conv_id").alias("of"), "last"),
        F.col("conv_id").eqNullSafe(F.col("of")),
    ).where("turns < last").select("turns", *SUMS).distinct()
    kept = ends.join(inner, ["turns", *SUMS], "left_anti").select(F.col("conv_id").alias("keeps"), "turns")
    out = hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("keeps")))
    rendered = render_turn(F.col("role"), F.col("text"))
    return out.select(
        "conv_id", "place", "turns", "role", "text", rendered.alias("rendered"), (F.col("ends_at") - F.length(rendered)).alias("starts_at"),
        F.concat_ws(":", *(F.hex(s) for s in SUMS)).alias("prefix_hash"),
    )
