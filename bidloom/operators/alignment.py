"""Where a quoted snippet stands on a page: seeds, longest common blocks, a floor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# The share of a snippet's words that must be found, and the least reach around the longest block.
MIN_MATCH_RATIO = 0.55
LEAST_REACH = 8
WORD = r"[a-zA-Z0-9\p{L}\p{N}]+"  # most characters are told by the first ranges


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), lambda w: F.xxhash64(F.lower(w)))


def seeds(texts: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, seed)``: hashes of the runs of ``k`` words of ``texts(key, t)``, ``t`` as ``words`` makes it."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("t").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(np.arange(len(flat)) + k <= np.cumsum(sizes)[row])
            seed = np.zeros(len(at), np.uint64)
            for i in range(k):
                seed = (seed ^ flat[at + i]) * np.uint64(0x9E3779B97F4A7C15)
                seed ^= seed >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row[at])), pa.array(seed.view(np.int64))], [key, "seed"])

    return texts.select(key, "t").mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, seed long")


def common_runs(page: np.ndarray, snippet: np.ndarray) -> np.ndarray:
    """Page places, snippet places and sizes of all maximal runs of equal words."""
    order = np.argsort(snippet, kind="stable")
    known = snippet[order]
    low = np.searchsorted(known, page, "left")
    there = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == page) if len(known) else np.zeros(0, np.int64)
    low, high = low[there], np.searchsorted(known, page[there], "right")
    i = np.repeat(there, high - low)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)] if len(i) else i
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    first = np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)])[: len(i)]
    size = np.diff(np.concatenate([np.flatnonzero(first), [len(i)]]))
    return np.stack([i[first], j[first], size])


def matching_blocks(page: np.ndarray, snippet: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks of the alignment: the longest common run, then the same to its left and right.

    Of equally long runs the first on the page is taken, then the first in the snippet. Blocks that touch on both
    sides are one. A region works on the runs that reach into it, cut to its bounds.
    """
    wide, high = len(page) + 1, len(snippet) + 1
    found, open_regions = [], [(0, len(page), 0, len(snippet), common_runs(page, snippet))]
    while open_regions:
        page_from, page_to, from_, to, runs = open_regions.pop()
        if not runs.size or page_from >= page_to or from_ >= to:
            continue
        a, b, size = runs
        skip = np.maximum(0, np.maximum(page_from - a, from_ - b))
        a, b, size = a + skip, b + skip, size - skip
        size = np.minimum(size, np.minimum(page_to - a, to - b))
        some = size > 0
        if not some.any():
            continue
        runs = np.stack([a, b, size])[:, some]
        a, b, size = runs
        # The longest, then the first on the page, then the first in the snippet.
        best = int(((size * wide + (wide - 1 - a)) * high + (high - 1 - b)).argmax())
        i, j, n = int(a[best]), int(b[best]), int(size[best])
        found.append((i, j, n))
        open_regions += [(page_from, i, from_, j, runs), (i + n, page_to, j + n, to, runs)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def near_blocks(blocks: list[tuple[int, int, int]], n_words: int) -> tuple[int, int | None, int | None]:
    """Words matched near the longest block, and the first and last place of these blocks."""
    if not blocks:
        return 0, None, None
    anchor, reach = max(blocks, key=lambda b: b[2]), max(n_words, LEAST_REACH)
    near = [b for b in blocks if abs(b[0] - anchor[0]) <= reach]
    return sum(b[2] for b in near), min(b[0] for b in near), max(b[0] + b[2] - 1 for b in near)


def align(pages: DataFrame, snippets: DataFrame, k: int = 3, floor: float = MIN_MATCH_RATIO) -> DataFrame:
    """``(snippet_id, page_id, n_words, matched, ratio, first_word, last_word)`` of snippets and the pages they may stand on.

    ``pages(page_id, text)``, ``snippets(snippet_id, text)``. A pair is formed by a run of ``k`` words that
    both hold, so no two texts meet that share none; a snippet of fewer than two words meets none, one of fewer than
    ``k`` is its own run. ``first_word`` and ``last_word`` number the page's words from 0 and are
    null where less than ``floor`` of the snippet's words was found near the longest block. Words are compared by
    64 bits of hash.

    Rows that share a run spread by the run, and texts meet their pairs by identifier, both sides shuffled for
    that join alone, so a page or snippet of very many pairs can be split. A pair is one row of a task.
    """
    of_pages = pages.select("page_id", words(F.col("text")).alias("t"))
    of_snippets = snippets.select("snippet_id", words(F.col("text")).alias("t")).where(F.size("t") >= 2)
    # A snippet shorter than k asks by runs of its own length: one more pass over the pages' words for each such length.
    wanted = written(of_snippets.select("snippet_id", F.least(F.lit(k), F.size("t")).alias("k"), "t"), "snippets")
    wanted_seeds, page_seeds = [], []
    for n in range(2, k + 1):
        mine = wanted.where(F.col("k") == n)
        if n == k or not mine.isEmpty():
            wanted_seeds.append(seeds(mine, "snippet_id", n))
            page_seeds.append(seeds(of_pages, "page_id", n))
    pairs = None
    for asked, there in zip(wanted_seeds, page_seeds, strict=True):
        met = there.join(asked, "seed").select("snippet_id", "page_id").distinct()
        pairs = met if pairs is None else pairs.union(met)
    pairs = written(pairs, "pairs")
    # Pages without a pair stop where they are read, as long as the identifiers of the others are few enough to broadcast.
    met_pages = of_pages.join(pairs.select("page_id").distinct(), "page_id", "left_semi").select("page_id", F.col("t").alias("page"))
    rows = pairs.join(wanted.select("snippet_id", F.col("t").alias("snippet")), "snippet_id").join(met_pages, "page_id")

    def run(batches):
        for batch in batches:
            out = []
            for page, snippet in zip(batch.column("page"), batch.column("snippet"), strict=True):
                page, snippet = page.values.to_numpy(), snippet.values.to_numpy()
                matched, first, last = near_blocks(matching_blocks(page, snippet), len(snippet))
                fits = matched / len(snippet) >= floor
                out.append((len(snippet), matched, first if fits else None, last if fits else None))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("snippet_id"), batch.column("page_id"), *columns], ["snippet_id", "page_id", "n_words", "matched", "first_word", "last_word"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("snippet_id", "page_id")]
    found = rows.select("snippet_id", "page_id", "snippet", "page").mapInArrow(run, ", ".join([*kinds, "n_words long, matched long, first_word long, last_word long"]))
    return found.select("snippet_id", "page_id", "n_words", "matched", (F.col("matched") / F.col("n_words")).alias("ratio"), "first_word", "last_word")
