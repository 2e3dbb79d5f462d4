"""Language identification with string kernels.

The kernel of two texts counts the n-grams that both hold, for all n from 1 to ``MOST`` (a blended
spectrum of presence), over the root of the product of their own counts. N-grams are of UTF-8 bytes
of the lower-cased text, in which digits, ASCII punctuation and white space are one space between words; they are
hashed to ``2 ** BITS`` numbers, so the kernel is one over hashed n-grams.

* Landmarks. A bounded sample of texts of known language (``max_rows``, shared out evenly over the
  languages) is collected as n-gram numbers; ``landmarks`` of its rows, dealt out over the languages, span the
  Nyström features ``k(x, L) k(L, L) ** -1/2``.
* Fit. Kernel ridge regression against +1 and -1 of each language, one versus rest, on these
  features, on the driver.
* Scores. The prediction is ``k(x, L)`` times a matrix of landmarks by languages, and ``k(x, L)`` is the
  matrix of n-grams by landmarks, so their product, n-grams by languages, is formed once and broadcast: its size is
  ``2 ** BITS`` by the number of languages whatever the table. A task multiplies the presence matrix of
  a slice of texts, sparse, with it.

Every text is scored whole, where it is read: nothing is shuffled.

Cases. A text that is null or has no letter is ``und`` with score 0. With no learned language all texts are ``und``; with
one, all others are of it. Of languages with equal scores the first by name is taken. A text counts once in
the fit however often its doc_id is repeated (the greatest text of a repeated doc_id, and of its
languages the greatest). A null doc_id is scored, not held out and not learned from. A null language is not
learned from. Very long texts are one row of their slice's matrix. An empty table gives an empty table. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import SAMPLE_BYTES, hash_share, held_out
from .scratch import Scratch
from .textops import _CLASS, mix, slices, tidy, trim

_U = np.uint64
BITS = 18
SIZE = 1 << BITS
MOST = 5
UNKNOWN = "und"
#: Languages that are learned at most: the most frequent ones.
MOST_LANGUAGES = 200
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[ord("A"), ord("a")]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with one space for what is no letter, before and after each text too; and which text each byte is of."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    letter = _LETTER[_CLASS[data]]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    kept = np.ones(len(data), bool)
    kept[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    return np.where(letter, _LOWER[data], 0x20)[kept].astype(np.uint8), owner[kept]


def gram_rows(texts: list[bytes], most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram numbers of each text, one text after the other, and where each text's begin (len + 1)."""
    data, owner = plain_bytes(texts)
    found, value = [], np.zeros(len(data), _U)
    for n in range(1, most + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        # n bytes and their number in one word of 64 bits: up to seven bytes are told apart before the hash.
        value = (value[:size] << _U(8)) | data[n - 1 :].astype(_U)
        whole = owner[:size] == owner[n - 1 :]
        number = mix(value | (_U(n) << _U(56))) >> _U(64 - BITS)
        found.append(((owner[:size].astype(np.int64) << np.int64(BITS)) | number.astype(np.int64))[whole])
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys & np.int64(SIZE - 1)).astype(np.int32), np.searchsorted(keys >> np.int64(BITS), np.arange(len(texts) + 1))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from ``at[i]`` to ``at[i + 1]``."""
    total = np.zeros((len(at) - 1, values.shape[1]), values.dtype)
    some = at[1:] > at[:-1]
    if some.any():
        total[some] = np.add.reduceat(values, at[:-1][some], axis=0)
    return total


def kernel(rows: list[np.ndarray], landmarks: list[np.ndarray], block: int = 32, most_rows: int = 1 << 17) -> np.ndarray:
    """Normalised presence kernel of n-gram rows with landmarks, in blocks of landmarks."""
    sizes = np.array([max(1, len(r)) for r in rows], float)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    cuts = [0]  # rows that are gathered at once
    while cuts[-1] < len(rows):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + most_rows, "right")) - 1))
    out = np.zeros((len(rows), len(landmarks)))
    for a in range(0, len(landmarks), block):
        some = landmarks[a : a + block]
        has = np.zeros((SIZE, len(some)), np.float32)
        for j, grams in enumerate(some):
            has[grams, j] = 1
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            out[b:e, a : a + len(some)] = row_sums(has[flat[at[b] : at[e]]], at[b : e + 1] - at[b])
    return out / np.sqrt(sizes[:, None] * np.array([max(1, len(g)) for g in landmarks], float)[None, :])


def ridge_model(rows: list[np.ndarray], languages: list[str], landmarks: int = 256, ridge: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, weights of n-grams by languages, and an intercept for each language.

    A text's prediction is the sum of its n-grams' weights over the root of their number, plus the
    intercept: kernel ridge regression on Nyström features, written out per n-gram.
    """
    names = sorted(set(languages))
    by_language = {n: [i for i, x in enumerate(languages) if x == n] for n in names}
    chosen: list[int] = []
    for place in range(max(map(len, by_language.values()), default=0)):
        chosen += [by_language[n][place] for n in names if place < len(by_language[n])]
    chosen = sorted(chosen[:landmarks])
    marks = [rows[i] for i in chosen]
    goal = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    middle = goal.mean(0) if len(goal) else np.zeros(len(names))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    strong = values > 1e-8 * max(values.max(initial=0), 1e-300)  # copies among the landmarks span nothing of their own
    root = vectors[:, strong] / np.sqrt(values[strong])
    features = kernel(rows, marks) @ root
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ (goal - middle))
    by_mark = root @ solved
    weights = np.zeros((SIZE, len(names)))
    for grams, w in zip(marks, by_mark, strict=True):
        weights[grams] += w / np.sqrt(max(1, len(grams)))
    return names, weights, middle


def predictions(texts: list[bytes], weights: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """A text per row, a language per column: presence times weights, a slice of texts at once."""
    numbers, at = gram_rows(texts)
    return row_sums(weights[numbers], at) / np.sqrt(np.maximum(1, np.diff(at)))[:, None] + middle


def has_letter(text: bytes) -> bool:
    """Whether a text holds a letter of any script."""
    ascii_letters = _LETTER[_CLASS[np.frombuffer(text, np.uint8)]] & (np.frombuffer(text, np.uint8) < 128)
    return bool(ascii_letters.any()) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def sampled_grams(docs: DataFrame, learnable, max_rows: int, max_bytes: int) -> list:
    """Rows ``(doc_id, lang, grams)`` of learnable documents, sorted by doc_id, on the driver.

    Each language has an equal share of ``max_rows``, chosen by a hash of doc_id; the last in
    that order stay behind where their n-grams take more than ``max_bytes``.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    per_language = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not per_language:
        return []
    share = max(1, max_rows // len(per_language))
    picked = F.lit(False)
    for r in per_language:
        picked = picked | ((F.col("lang") == r["lang"]) & hash_share(F.col("doc_id"), share + 4 * int(share**0.5), r["count"]))
    once = known.where(picked).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("lang").alias("lang"))

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                numbers, at = gram_rows(texts)
                grams = [numbers[a:z].astype("<i4").tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(first, len(texts)) for j in range(2)), pa.array(grams, pa.binary())], ["doc_id", "lang", "grams"])

    scratch = Scratch(docs.sparkSession)
    try:
        table = scratch.table(once.select("doc_id", "lang", "text").mapInArrow(tidy(run), "doc_id long, lang string, grams binary"), "grams")
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        sizes = table.select("doc_id", F.octet_length("grams").alias("size")).orderBy(*order).limit(max_rows).collect()
        fit = int(np.searchsorted(np.cumsum([r["size"] for r in sizes], dtype=np.int64), max_bytes, "right"))
        return sorted(table.orderBy(*order).limit(fit).collect(), key=lambda r: r["doc_id"])
    finally:
        scratch.drop()


def language_scores(docs: DataFrame, modulus: int = 5, remainder: int = 0, max_rows: int = 3000, landmarks: int = 256, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Languages are read only where crc32 of the doc_id modulo ``modulus`` is not ``remainder``, in a
    sample of ``max_rows`` rows at most. ``score`` is the prediction, from -1 to 1, brought to 0 to 1.
    """
    docs = docs.select("doc_id", "text", "lang")
    got = sampled_grams(docs, ~held_out(F.col("doc_id"), modulus, remainder), max_rows, max_bytes)
    model = ridge_model([np.frombuffer(r["grams"], "<i4") for r in got], [r["lang"] for r in got], landmarks) if got else ([], np.zeros((SIZE, 0)), np.zeros(0))
    del got
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, weights, middle = shared.value
        known = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                letters = np.array([bool(names) and has_letter(t) for t in texts])
                best, score = np.full(len(texts), len(names)), np.zeros(len(texts))
                if letters.any():
                    values = predictions(texts, weights, middle)
                    best[letters] = values[letters].argmax(1)
                    score[letters] = np.clip((values[letters].max(1) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(known[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    scored = lowered.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
