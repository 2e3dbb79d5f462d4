"""Vectorised word hashing shared by the text operators of this subpackage.

Everything here runs inside Spark tasks, on one slice of an Arrow batch at a time: a slice
holds about ``SLICE_BYTES`` of text (one document when that document alone is longer), so the
memory of a task does not grow with the table or with the number of rows of a batch.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased.
Words are hashed to 64 bits by a keyed polynomial over their bytes, which needs one pass of
numpy over the slice instead of a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
for _t in (_BYTE, _BYTE_LOWER):
    _t[_WHITE] = 0

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer slice comes."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def tidy(run):
    """``run`` of batches, which at its end gives freed memory back: a Python worker lives on and serves other stages."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one byte array."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, _U), e, e
    word = np.empty(n + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_WHITE[data]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(n)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of about ``SLICE_BYTES``; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        data = value.as_py() or b""
        if held and size + len(data) > SLICE_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several texts, where each text's words begin (len + 1), the joined bytes.

    The texts are joined by a space, which belongs to no word.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    hashes, starts, _ = word_hashes(data, lower)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, at), data


_SALT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words; one window, of all words, when there are fewer than k."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.zeros(n - width + 1, _U)
    for j in range(width):
        out += words[j : n - width + 1 + j] * _SALT[j % 64] + _U(j)
    return mix(out + _U(width))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(ngram_hashes(words, k))


#: Byte classes for word shapes: letters and digits become one letter, other bytes stay.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")


def shape_hashes(data: np.ndarray) -> np.ndarray:
    """A hash per word of its shape: runs of one byte class count once (``Wort!!`` is ``Aa!``)."""
    if not len(data):
        return np.zeros(0, _U)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | _WHITE[data[1:]]
    return word_hashes(kind[keep], lower=False)[0]


def letters_only(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII punctuation and digits as spaces, so that ``word,`` meets ``word``."""
    out = data.copy()
    kind = _CLASS[data]
    out[(kind != ord("A")) & (kind != ord("a"))] = 0x20
    return out
