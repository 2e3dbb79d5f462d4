"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (positives) and texts whose labels it does not look at, a
sample of the whole corpus. With the class prior
pi, the risk of a classifier is estimated as ``pi * R(positive, +1) + max(0, R(unlabelled, -1) -
pi * R(positive, -1))``: unlabelled texts count as negatives, less the share of positives that is
known to be among them. Where the corrected negative part falls below zero the step goes against
it, so the model cannot gain by memorising the unlabelled rows.

The model is linear over hashed indicators and is fitted by numpy on bounded samples (``max_rows``
labelled and ``max_unlabelled`` other texts, and a bound on their features' bytes); all documents are
scored in Spark tasks.

Cases. Null and empty texts get the score of the bias alone; very long texts are scored whole.
Repeated rows come back once each, and a doc_id counts once in the samples.
Without any positive or any unlabelled row the score is the prior (0 for no labels at all). A null
doc_id is scored and not held out. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import SAMPLE_BYTES, SIZE, Sparse, document_counts, hash_share, held_out, judged, labelled_sample, sampled_features, score_documents, sigmoid
from .textops import trim


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-4, min_documents: int | None = None, lift: float = 1.5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss.

    Only features of at least ``min_documents`` positives (by default a fortieth of them, within 3
    and 5) whose share among the positives is
    ``lift`` times that among the unlabelled texts get a weight: of an open vocabulary nearly all
    words are noise. At the end the bias is set so that the mean score of the unlabelled texts is
    the prior.
    """
    if not positive or not unlabelled:
        return np.zeros(SIZE), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    found, seen = document_counts(positive), document_counts(unlabelled)
    least = min_documents or max(3, min(5, len(positive) // 40))
    use = (found >= min(least, len(positive))) & (found * len(unlabelled) >= lift * seen * len(positive))
    columns = np.flatnonzero(use)
    p, u = (Sparse([np.searchsorted(columns, r[use[r]]) for r in rows], len(columns)) for rows in (positive, unlabelled))
    w, b = np.zeros(len(columns)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        sp, su = p.scores(w) + b, u.scores(w) + b
        loss_u, loss_p = np.logaddexp(0, su).mean(), np.logaddexp(0, sp).mean()
        negative = loss_u - prior * loss_p
        gu, gp = sigmoid(su) / len(su), -prior * sigmoid(sp) / len(sp)
        if negative >= 0:
            by_u, by_p = gu, gp - prior * sigmoid(-sp) / len(sp)
        else:  # back out of the part that went below zero
            by_u, by_p = -gu, -gp
        g = p.gradient(by_p) + u.gradient(by_u) + decay * w
        gb = by_p.sum() + by_u.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        size = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= size * m / (np.sqrt(v) + 1e-8)
        b -= size * mb / (np.sqrt(vb) + 1e-8)
    su, low, high = u.scores(w), b - 12.0, b + 12.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(su + middle).mean() < prior else (low, middle)
    weights = np.zeros(SIZE)
    weights[columns] = w
    return weights, (low + high) / 2


def unlabelled_sample(docs: DataFrame, modulus: int, remainder: int, max_rows: int) -> list[np.ndarray]:
    """Features of a sample of all documents but the held-out ones, by a hash of doc_id; labels are not looked at."""
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    some = some.where(hash_share(F.col("doc_id"), max_rows, some.count()))
    return [np.frombuffer(r["features"], "<i4") for r in sampled_features(some, [], max_rows, SAMPLE_BYTES, shapes=False)]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, max_rows: int = 8000, max_unlabelled: int = 8000, prior: float | None = None
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Labels are read only where crc32 of the doc_id modulo ``modulus`` is not ``remainder``. The
    confirmed toxic texts of a bounded sample of these are the positives. ``prior`` is the share of
    toxic texts in the corpus; by default the share among the labels of the sample, which supposes
    that labels were given without regard to toxicity.
    """
    rows, by = labelled_sample(docs, labels, ["toxic"], modulus, remainder, max_rows, shapes=False)
    toxic = by["toxic"] == 1
    share = prior if prior is not None else float(toxic.mean()) if len(rows) else 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    positive = [r for r, t in zip(rows, toxic, strict=True) if t]
    unlabelled = unlabelled_sample(docs, modulus, remainder, max_unlabelled) if positive else []
    weights, bias = fit_nnpu(positive, unlabelled, share)
    del rows, positive, unlabelled
    trim()
    return judged(score_documents(docs, weights, bias, shapes=False), modulus, remainder, threshold)
