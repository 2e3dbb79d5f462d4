"""Features and learners shared by the classifiers of this subpackage.

A document's features are hashed indicators (each counts once however often it occurs): words
lower-cased without punctuation, the words' first four and seven bytes, two- and three-grams of word shapes,
and repetition of a word. They are made in Spark tasks; a learner sees a bounded sample of
labelled rows as arrays of feature numbers, on the driver, and gives a weight per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import _SALT, letters_only, mix, shape_hashes, slices, tidy, word_hashes, words_of

BITS = 20
SIZE = 1 << BITS
_U = np.uint64
_REPEAT = _U(0xB5297A4D)
_PREFIXES = (4, 7)
#: Features that a learner collects, in bytes: some 20 MB for 8000 documents of usual length.
SAMPLE_BYTES = 96 << 20


def _hashed(values: np.ndarray, family: int) -> np.ndarray:
    return (mix(values + _SALT[family]) >> _U(64 - BITS)).astype(np.int32)


def _prefix_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes of each word."""
    short = data.copy()
    size_of = stops - starts
    for shift in range(size, int(size_of.max(initial=0))):
        if shift == 4 * size:  # the rest of the few longer words
            for a, z in zip(starts[size_of > shift], stops[size_of > shift], strict=True):
                short[a + shift : z] = 0x20
            break
        short[starts[size_of > shift] + shift] = 0x20
    return word_hashes(short)[0]


def features_of(texts: list[bytes], words: bool = True, shapes: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct feature numbers of each text, and its number of words."""
    _, at, data = words_of(texts)
    plain, plain_at, shape, raw = None, None, None, None
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    if words:
        kept = letters_only(data)
        plain, starts, stops = word_hashes(kept)
        plain_at = np.searchsorted(starts, ends)
        plain_f = _hashed(plain, 1)
        prefix_f = [_hashed(_prefix_hashes(kept, starts, stops, n), 7 + n) for n in _PREFIXES]
    if shapes:
        raw = word_hashes(data)[0]
        shape = shape_hashes(data)
    out = []
    for i in range(len(texts)):
        parts = []
        if words:
            a, b = plain_at[i], plain_at[i + 1]
            parts += [plain_f[a:b], *(p[a:b] for p in prefix_f)]
        if shapes:
            a, b = at[i], at[i + 1]
            s, w = shape[a:b], raw[a:b]
            same = w[1:] == w[:-1]
            parts += [_hashed(s, 3), _hashed(s[1:] * _SALT[20] + s[:-1], 4), _hashed(s[2:] * _SALT[21] + s[1:-1] * _SALT[20] + s[:-2], 5)]
            if same.any():
                parts.append(_hashed(np.array([_REPEAT, _REPEAT + _U(1 + (same[1:] & same[:-1]).any())]), 6))
        out.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32))
    return out, np.diff(at)


def featurise(docs: DataFrame, carry: list[str], words: bool = True, shapes: bool = True) -> DataFrame:
    """``carry`` columns (after text) with ``features``, the feature numbers as little-endian int32."""
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                found, _ = features_of(texts, words, shapes)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j + 1).slice(first, len(texts)) for j in range(len(carry))), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())],
                    [*carry, "features"],
                )

    return docs.select("text", *carry).mapInArrow(tidy(run), f"{fields}, features binary")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def hash_share(doc_id: Column, wanted: int, there: int) -> Column:
    """Whether a hash of doc_id is among the lowest, so that about ``wanted`` of ``there`` ids are."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(there, 1))) + 1


def sampled_features(docs: DataFrame, carry: list[str], max_rows: int, max_bytes: int, words: bool = True, shapes: bool = True) -> list:
    """Rows ``(doc_id, *carry, features)`` of ``docs(doc_id, text, *carry)``, sorted, on the driver.

    One row per doc_id (the greatest text of a repeated one). At most ``max_rows`` rows whose
    features take ``max_bytes`` together come back, in the order of a hash of doc_id: the
    features are written first, so what is collected is known before it is.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        once = docs.groupBy("doc_id").agg(F.max("text").alias("text"), *(F.max(c).alias(c) for c in carry))
        table = scratch.table(featurise(once, ["doc_id", *carry], words, shapes), "features")
        sizes = table.select("doc_id", F.octet_length("features").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_rows).collect()
        total = np.cumsum([r["size"] for r in sizes], dtype=np.int64)
        fit = int(np.searchsorted(total, max_bytes, "right"))
        if fit < len(sizes):
            table = table.where(F.xxhash64("doc_id") < sizes[fit]["h"])
        return sorted(table.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect(), key=lambda r: r["doc_id"])
    finally:
        scratch.drop()


def labelled_sample(
    docs: DataFrame, labels: DataFrame, targets: list[str], modulus: int, remainder: int, max_rows: int, words: bool = True, shapes: bool = True, max_bytes: int = SAMPLE_BYTES
):
    """Feature arrays and label columns of at most ``max_rows`` labelled documents.

    Rows are chosen by a hash of doc_id, so the same rows come back on every run. Labels of a
    doc_id that occurs repeatedly are merged by their maximum, rows with a null label left out, and
    a doc_id counts once however often ``docs`` has it. Features of more than ``max_bytes`` in all
    are not collected: the rows last in the order stay behind. The label side is bounded by
    ``max_rows`` and joined by broadcast: texts without a chosen label are not shuffled.
    """
    seen = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    seen = seen.groupBy("doc_id").agg(*(F.max(t).alias(t) for t in targets)).dropna()
    n = seen.count()
    if n > max_rows:
        seen = seen.where(hash_share(F.col("doc_id"), max_rows + 4 * int(max_rows**0.5), n))
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    got = sampled_features(docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id"), targets, max_rows, max_bytes, words, shapes)
    return [np.frombuffer(r["features"], "<i4") for r in got], {t: np.array([r[t] for r in got], np.int64) for t in targets}


class Sparse:
    """Rows of feature numbers with the sums that the learners need."""

    def __init__(self, rows: list[np.ndarray], size: int = SIZE):
        self.rows, self.size = rows, size
        self.at = np.cumsum([0] + [len(r) for r in rows])
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.at))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], len(self.rows))

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, by_row[self.owner], self.size)


def document_counts(rows: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(rows), minlength=SIZE) if rows else np.zeros(SIZE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_line(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over scores (Platt), by Newton steps."""
    if not len(labels) or labels.min() == labels.max():
        return 1.0, 0.0
    spread = scores.std() or 1.0
    x, n1 = scores / spread, labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return a / spread, b


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, words: bool = True, shapes: bool = True, norm: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, score)``: the logistic of the weights' sum over each whole text's features.

    With ``norm``, the sum is divided by the root of the sum of ``norm`` over the features. The
    broadcast arrays have ``SIZE`` entries whatever the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float64), float(bias), norm))

    def run(batches):
        w, b, squares = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                found, _ = features_of(texts, words, shapes)
                sums = np.array([w[f].sum() for f in found])
                if squares is not None:
                    sums = sums / np.sqrt(np.array([squares[f].sum() for f in found]) + 1e-12)
                scores = sigmoid(sums + b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def judged(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
