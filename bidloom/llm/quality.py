"""Quality by naive Bayes support vectors.

Each n-gram indicator is scaled by its log-count ratio between good and bad texts,
``r = log((a + p) / |a + p|) - log((a + q) / |a + q|)``; a linear model with the hinge loss is then
fitted over the scaled indicators by dual coordinate descent: one dual variable per text, kept in
``[0, cost]``, is set to its optimum in turn while the weight vector follows. A logistic curve
fitted to the margins of texts left out of the fit turns margins into scores.

The fit reads a bounded sample of labelled rows (``max_rows``) on the driver; all documents are
scored in Spark tasks.

Cases. Null and empty texts have no n-grams and get the score of the bias. Repeated rows come
back once each. With labels of one class only, or none, every score is 0.5. A null doc_id is scored
and not held out. A very long text is scored whole, in a slice of its own. Ties: equal texts have equal scores, and a
score of exactly the threshold is accepted; of repeated labels of a doc_id the largest counts. An empty
table gives an empty table. Further columns are ignored by ``quality_scores`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .learn import SIZE, Sparse, document_counts, features_of, fit_line, judged, labelled_sample, score_documents, sigmoid
from .textops import slices, tidy, trim


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    good = smooth + document_counts([r for r, y in zip(rows, labels, strict=True) if y == 1])
    bad = smooth + document_counts([r for r, y in zip(rows, labels, strict=True) if y != 1])
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 0.1, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights (of unscaled indicators) and bias of the hinge-loss model over ``scale * indicator``.

    Each text's scaled vector is brought to unit length, so long texts do not outweigh short ones.
    """
    rng = np.random.default_rng(seed)
    y = np.where(labels == 1, 1.0, -1.0)
    values = [scale[r] for r in rows]
    values = [v / (np.sqrt(v @ v + 1e-12)) for v in values]
    square = np.array([v @ v + 1.0 for v in values])  # the last coordinate is the bias
    dual, w, b = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    weight = np.where(y > 0, 1.0, (y > 0).sum() / max(1, (y < 0).sum())) * cost * 10
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], values[i]
            g = y[i] * (w[f] @ x + b) - 1.0
            new = min(max(dual[i] - g / square[i], 0.0), weight[i])
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[f] += step * x
                b += step
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, b


def quality_model(rows: list[np.ndarray], labels: np.ndarray, left_out: int = 5):
    """Scale, weights, bias and curve; None where the labels do not hold both classes."""
    fold = np.arange(len(rows)) % left_out == 0
    fit = [r for r, f in zip(rows, fold, strict=True) if not f]
    if len(set(labels[~fold])) < 2:
        return None
    scale = log_count_ratio(fit, labels[~fold])
    weights, bias = dual_coordinate_descent(fit, labels[~fold], scale)
    held = [r for r, f in zip(rows, fold, strict=True) if f]
    return scale, weights, bias, fit_line(margins(held, scale, weights, bias), labels[fold])


def margins(rows: list[np.ndarray], scale: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    s = Sparse(rows)
    length = np.sqrt(s.scores(scale * scale) + 1e-12)
    return s.scores(scale * weights) / length + bias


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Labels are read only where crc32 of the doc_id modulo ``modulus`` is not ``remainder``.
    """
    rows, by = labelled_sample(docs, labels, ["quality"], modulus, remainder, max_rows)
    model = quality_model(rows, by["quality"])
    del rows
    trim()
    if model is None:
        return judged(score_documents(docs, np.zeros(SIZE), 0.0), modulus, remainder, threshold)
    scale, weights, bias, (slope, shift) = model
    return judged(
        score_documents(docs, slope * scale * weights, slope * bias + shift, norm=scale * scale), modulus, remainder, threshold
    )


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns.

    Rows are filtered where they are read: nothing is shuffled.
    """
    rows, by = labelled_sample(docs, labels, ["quality"], modulus, remainder, max_rows)
    model = quality_model(rows, by["quality"])
    del rows
    trim()
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scale, weights, bias, (slope, shift) = shared.value
        value, square = scale * weights, scale * scale
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                found, _ = features_of(texts)
                margin = np.array([value[f].sum() / np.sqrt(square[f].sum() + 1e-12) for f in found]) + bias
                yield batch.slice(first, len(texts)).filter(pa.array(sigmoid(slope * margin + shift) >= threshold))

    plain = [f"c{i}" for i in range(len(docs.columns))]  # Spark would read a dot in a name as a field
    return docs.toDF(*plain).mapInArrow(tidy(run), StructType([StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)])).toDF(*docs.columns)
