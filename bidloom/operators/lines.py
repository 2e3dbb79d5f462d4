"""Words in reading order as lines: each line is measured from its first word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import previous, ranged, running_over

# Fixed value: how far, in points, a word may stand above or below the first word of its line.
LINE_LIMIT = 3.0


def _fold(limit: float, n_key: int, carried: list[str]):
    """Numbers of lines within each stretch, for rows sorted by stretch; the state is one anchor."""

    def run(batches):
        stretch, anchor, line = None, 0.0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_key)), strict=True))
            at = batch.column(n_key).to_pylist()
            out = np.empty(len(at), np.int64)
            for i, (k, v) in enumerate(zip(keys, at, strict=True)):
                if k != stretch:
                    stretch, anchor, line = k, v, 0
                elif abs(v - anchor) > limit:
                    anchor, line = v, line + 1
                out[i] = line
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*carried, "_line"])

    return run


def with_lines(words: DataFrame, key: list[str], order: list[str], at: str, limit: float = LINE_LIMIT, rising: bool = False) -> DataFrame:
    """``words`` with ``line``, ``struct(stretch, line)``: words in order share a line while ``at`` stays within ``limit`` of its first word's.

    A fold, but one that is cut where the outcome is certain whatever came before: after a step of more than
    twice the limit, or of more than the limit where ``at`` never falls (``rising``), a line begins. The
    stretches between are folded apart from each other, so a key of very many rows is many stretches;
    one that has no such step is read as a stream, with one number as its state.

    Rows without ``at`` are left out. ``order`` has to tell a key's rows apart.
    """
    cut = ranged(words.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("double")), key, order)
    stepped = previous(cut, key, order, "_at", "_was")
    step = F.abs(F.col("_at") - F.col("_was")) > (limit if rising else 2 * limit)
    begins = stepped.withColumn("_begins", (F.col("_was").isNull() | step).cast("long"))
    numbered = running_over(begins, key, order, {"_stretch": F.col("_begins")})
    by = [*key, "_stretch"]
    dealt = numbered.select(*by, "_at", *(F.col(c) for c in words.columns if c not in key)).repartition(*by).sortWithinPartitions(*by, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    folded = dealt.mapInArrow(_fold(limit, len(by), dealt.columns), f"{fields}, _line long")
    return folded.select(*words.columns, F.struct(F.col("_stretch").alias("stretch"), F.col("_line").alias("line")).alias("line"))


def line_boxes(words: DataFrame, key: list[str], order: list[str], limit: float = LINE_LIMIT) -> DataFrame:
    """``(key, line, words, x0, top, x1, bottom)``: one box per line of ``words(key, order, x0, top, x1, bottom)``."""
    return with_lines(words, key, order, "top", limit).groupBy(*key, "line").agg(
        F.count("*").alias("words"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")
    )


def highlight_boxes(words: DataFrame, found: DataFrame, first: Column, last: Column) -> DataFrame:
    """Boxes of the words ``first`` to ``last`` of each row ``found(snippet_id, page_id, ...)``, one per line.

    ``words(page_id, word_no, x0, top, x1, bottom)`` are numbered from 0 in reading order.
    """
    spans = found.where(first.isNotNull()).select("snippet_id", "page_id", F.explode(F.sequence(first, last)).alias("word_no"))
    return line_boxes(spans.join(words, ["page_id", "word_no"]), ["snippet_id", "page_id"], ["word_no"])
