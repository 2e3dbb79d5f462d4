"""Periodic runs of words: maximal repetitions by Lyndon roots.

A run is a stretch of words with smallest period q that no neighbouring word extends. By the runs
theorem the longest Lyndon word at some place of every run is the run's root, under the order of the
words or under its reverse. So for each of the two orders

* a scan from right to left keeps the next smaller suffix of each place (a stack, as links), which
  ends the longest Lyndon word there. Suffixes are compared by their longest common extension (LCE): a
  binary search over rolling hashes, the words found equal compared directly. What is known of one
  distance is carried on to the left, so a long periodic stretch is compared once;
* each place whose Lyndon word occurs twice in a row (every place, where runs of less than three periods are
  asked for) is extended to both sides, all places at once by a vectorised binary search over the same
  hashes; the runs found are compared word by word.

No suffix array is built. Before the scan, stretches that can't hold a run are left out: in a run of
period q and of ``least_exponent * q`` words every word but the last q comes again within q words, so a
block of words that come again, m words long, has no distance above ``m / (least_exponent - 1)``. Blocks are cut at greater
distances until nothing changes, or some passes are over; this loses no run, and usual prose leaves nothing to scan.

Everything happens in one row: nothing is shuffled, and a lost task is run again.

Cases. A null or empty text has no words, no runs and an empty collapsed text. Words are compared as
bytes, case included. Repeated rows come back once each; a null doc_id is kept. A very long text takes
memory in proportion to its words and time of about n log n. An empty table gives an empty table.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import _BASE, _MASK, _power_tables, mix, tidy

_U = np.uint64
_FAR = np.int64(1) << np.int64(40)
SLICE_CHARS = 1 << 20
PASSES = 64
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


# ---------------------------------------------------------------- words


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of several texts, and where each text's words begin (len + 1)."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    empty = pc.equal(flat, "")  # of a text without a word
    if pc.any(empty).as_py():
        gone = empty.to_numpy(zero_copy_only=False)
        flat = flat.filter(pc.invert(empty))
        at = at - np.concatenate([[0], np.cumsum(gone)])[at]
    return flat, at


def next_distances(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words from each word to the next equal one of the same text; a large number where there is none."""
    place = np.sort((codes.astype(np.int64) << np.int64(32)) | np.arange(len(codes), dtype=np.int64))
    here = place & np.int64(0xFFFFFFFF)
    same = (place[1:] >> np.int64(32)) == (place[:-1] >> np.int64(32))
    out = np.full(len(codes), _FAR)
    out[here[:-1][same]] = (here[1:] - here[:-1])[same]
    last = np.repeat(at[1:], np.diff(at))
    out[np.arange(len(codes)) + out >= last] = _FAR
    return out


def candidate_blocks(distance: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int]]:
    """Blocks ``[begin, end)`` of words that come again, outside of which no run has a word but its last q.

    Each pass leaves out less than the one before; after ``PASSES`` of them what is left is scanned as it is.
    """
    place = np.flatnonzero(distance < _FAR)
    for n in range(PASSES):
        if not len(place):
            break
        first = np.concatenate([[True], np.diff(place) != 1])
        number = np.cumsum(first) - 1
        size = np.bincount(number)
        most = size // (least_exponent - 1)
        # A run of q has max(least_words, least_exponent * q) - q words here: at least this many.
        most[size < max(least_exponent - 1, min(least_words - 1, least_words * (least_exponent - 1) // least_exponent))] = 0
        stays = distance[place] <= most[number]
        if stays.all() or n == PASSES - 1:
            begin = place[first]
            return list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        place = place[stays]
    return []


# ---------------------------------------------------------------- common extensions


class Extensions:
    """Longest common extensions of the suffixes of one sequence of numbers, by rolling hashes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.power = _power_tables(self.n + 1)[0]
        self.total = np.zeros(self.n + 1, _U)
        np.cumsum(mix(codes.astype(_U) + _U(_BASE)) * self.power[: self.n], out=self.total[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from i and from j have equal hashes (i <= j)."""
        t = self.total
        return (t[i + size] - t[i]) * self.power[j - i] == t[j + size] - t[j]

    def _search(self, most: np.ndarray, holds) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._search(self.n - j, lambda m: self.equal(i, j, m))

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        return self._search(i.copy(), lambda m: self.equal(i - m, j - m, m))


def next_smaller(codes: list[int], total: list[int], power: list[int], falls: bool) -> list[int]:
    """For each place the next one with a smaller suffix, the length if there is none.

    With ``falls`` the order of the words is reversed. In both orders a suffix that begins another
    is the smaller one. ``total`` and ``power`` are those of ``Extensions``.
    """
    n = len(codes)
    out = [n] * n
    known: dict[int, tuple[int, int]] = {}  # distance: a stretch of places whose words come again at it

    def common(i: int, j: int) -> int:
        """The place after i where the words from i and j first differ."""
        step = j - i
        low, high = known.get(step, (n, n))
        if low <= i + 1 and i < high:  # next to the stretch, or in it
            known[step] = (min(low, i), high)
            return high
        least, most, p = 1, n - j, power[step]
        while least < most:
            m = (least + most + 1) >> 1
            if (((total[i + m] - total[i]) * p - total[j + m] + total[j]) & _MASK) == 0:
                least = m
            else:
                most = m - 1
        end, reach = i + least, low if i < low <= i + least else i + least
        if codes[i:reach] != codes[j : reach + step]:  # equal hashes of other words
            end = i + 1
            while end + step < n and codes[end] == codes[end + step]:
                end += 1
        elif reach < end:
            end = high
        known[step] = (i, end)
        return end

    for i in range(n - 1, -1, -1):
        a, j = codes[i], i + 1
        while j < n:
            b = codes[j]
            if a == b:
                k = common(i, j)
                if k + j - i >= n:  # the suffix at j begins the one at i
                    break
                rises = codes[k] < codes[k + j - i]
            else:
                rises = a < b
            if rises == falls:
                break
            j = out[j]
        out[i] = j
    return out


def runs_of(codes: np.ndarray, distance: np.ndarray, least_words: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one sequence, by start, then period.

    ``distance`` is that of ``next_distances``.
    """
    n, stretches = len(codes), []
    for begin, end in candidate_blocks(distance, least_words, least_exponent):
        end = min(n, end + (end - begin) // (least_exponent - 1) + 1)
        if stretches and begin < stretches[-1][1]:
            stretches[-1][1] = max(end, stretches[-1][1])
        else:
            stretches.append([begin, end])
    if not stretches:
        return []
    ext, found = Extensions(codes), []
    for begin, end in stretches:
        values = codes[begin:end].tolist()
        total, power = ext.total[begin : end + 1].tolist(), ext.power[: end - begin + 1].tolist()
        for falls in (False, True):
            i = np.arange(begin, end)
            q = np.array(next_smaller(values, total, power, falls), np.int64) + begin - i
            if least_exponent >= 3:  # the root at some place of the first q is followed by itself
                fits = i + 2 * q <= n
                i, q = i[fits], q[fits]
                twice = ext.equal(i, i + q, q)
                i, q = i[twice], q[twice]
            left = ext.left(i, i + q)
            found.append(np.stack([i - left, left + q + ext.right(i, i + q), q], 1))
    out = set()
    for start, length, q in np.unique(np.concatenate(found), axis=0).tolist():
        if length >= max(least_words, least_exponent * q):
            run = (start, length, q) if is_run(codes, start, length, q) else extended(codes, start, q)
            if run[1] >= max(least_words, least_exponent * q):
                out.add(run)
    return sorted(out, key=lambda r: (r[0], r[2]))


def is_run(codes: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether the words of a stretch have the period and its neighbours do not, word by word."""
    end = start + length
    return (
        np.array_equal(codes[start : end - q], codes[start + q : end])
        and (start == 0 or codes[start - 1] != codes[start - 1 + q])
        and (end == len(codes) or codes[end] != codes[end - q])
    )


def extended(codes: np.ndarray, start: int, q: int) -> tuple[int, int, int]:
    """The longest stretch of period q that holds ``start``, word by word (for words that hashes took for equal)."""
    differs = np.flatnonzero(codes[q:] != codes[:-q])
    at = np.searchsorted(differs, start)
    first = int(differs[at - 1]) + 1 if at else 0
    last = int(differs[at]) if at < len(differs) else len(codes) - q
    return first, last - first + q, q


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, or only among the first q of their runs."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


# ---------------------------------------------------------------- Spark


def _slices(texts: pa.Array):
    """(first row, texts) of about ``SLICE_CHARS`` bytes, one text when that alone is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_CHARS:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += size
    if len(texts) > first:
        yield first, texts.slice(first)


def word_runs(docs: DataFrame, least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """``(doc_id, runs, collapsed)`` for every row of ``docs(doc_id, text)``.

    ``runs`` are the maximal stretches with smallest period q of at least ``least_words`` and
    ``least_exponent * q`` words (an exponent of 2 finds all repetitions), by start, then period.
    ``collapsed`` has the words, joined by one space, without those that any run holds after its first q.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its root at least twice")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                words, at = split_words(texts)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                distance = next_distances(codes, at)
                runs, lists = [], pa.ListArray.from_arrays(pa.array(at, pa.int32()), words)
                collapsed = pc.binary_join(lists, " ").to_pylist()
                for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    found = runs_of(codes[a:z], distance[a:z], least_words, least_exponent)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    if found:
                        collapsed[k] = " ".join(words.slice(a, z - a).filter(pa.array(kept_words(z - a, found))).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(runs, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"]
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id long, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equals the first. Null without runs."""
    none = F.lit(None).cast(RUNS[6:-1])
    return F.aggregate(
        runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    )
