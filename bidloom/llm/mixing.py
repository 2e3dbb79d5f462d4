"""Soft-membership mixing: document rates whose expected domain tokens match targets.

A document belongs to domains softly. A softmax model over hashed indicators, trained on labelled
rows, gives its posteriors; with ``n`` tokens and posterior ``p_k`` it brings ``n * p_k`` expected
tokens to domain k per copy. Nonnegative rates are fitted by projected-gradient least squares on
the domain totals, starting from one copy of each document.

A step subtracts ``p . v`` from every rate and cuts at zero, where v is the residual of the totals
times the inverse of the domains' second moments, so without the cut one step is exact. A rate is
thus a fold over the steps' vectors v, a handful of numbers: each step is one aggregation of the
small table of posteriors, nothing per document is kept between steps, and a lost task is simply
run again.

Cases. Null and empty texts have no tokens and rate 1 less their posterior's steps; a very long text
is one document with many tokens. Repeated rows count as documents of their own, have equal rates
and equal numbers of copies. Without labels, or with one domain only, every rate is the target total
over the total. An empty table gives an empty table. A null doc_id keeps its row. Further columns
are ignored by ``mixture`` and kept by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .learn import SIZE, Sparse, document_counts, features_of, labelled_sample
from .scratch import Scratch
from .textops import slices, tidy, trim

#: Domain names of the labels (quality, toxic), and the shares of tokens wanted of each.
DOMAINS: dict[tuple[int, int], str] = {(1, 0): "clean", (0, 0): "junk", (1, 1): "toxic", (0, 1): "toxic_junk"}
TARGETS: dict[str, float] = {"clean": 0.9, "junk": 0.05, "toxic": 0.04, "toxic_junk": 0.01}
#: Domains that nobody wants more of: their targets can be taken as upper bounds.
UNWANTED = ("junk", "toxic", "toxic_junk")


def fit_softmax(
    rows: list[np.ndarray], domain: np.ndarray, k: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-3, min_documents: int = 5, lift: float = 3.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers in use, weights (domains x these) and biases by Adam on the multinomial logistic loss.

    A feature takes part when some domain holds it in ``min_documents`` texts or more and at
    ``lift`` times the overall share.
    """
    total, use = document_counts(rows), np.zeros(SIZE, bool)
    for d in range(k):
        own = document_counts([r for r, y in zip(rows, domain, strict=True) if y == d])
        size = max(1, int((domain == d).sum()))
        use |= (own >= min(min_documents, size)) & (own * len(rows) >= lift * total * size)
    columns = np.flatnonzero(use).astype(np.int32)
    x = Sparse([np.searchsorted(columns, r[use[r]]) for r in rows], len(columns))
    w, b = np.zeros((k, len(columns))), np.log(np.bincount(domain, minlength=k) + 1.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    goal = np.eye(k)[domain]
    for t in range(1, steps + 1):
        e = (posteriors(np.stack([x.scores(w[d]) for d in range(k)], 1) + b) - goal) / len(rows)
        size = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        g = np.stack([x.gradient(e[:, d]) for d in range(k)]) + decay / len(rows) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - size * m / (np.sqrt(v) + 1e-8)
        gb = e.sum(0)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b = b - size * mb / (np.sqrt(vb) + 1e-8)
    return columns, w, b


def posteriors(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def domain_posteriors(docs: DataFrame, columns: np.ndarray, weights: np.ndarray, bias: np.ndarray, carry: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, p0, p1, ...)``; tokens are words.

    With ``carry``, the struct ``row`` of all columns of ``docs`` stands in for doc_id.
    """
    k = len(bias)
    shared = docs.sparkSession.sparkContext.broadcast((columns, np.vstack([weights.T, np.zeros((1, k))]), bias))
    names = docs.columns if carry else ["doc_id", "text"]
    at = names.index("text")
    # Spark would read a dot in a name as a field, so columns go by number and get their names back in the struct.
    source = docs.toDF(*(f"c{i}" for i in range(len(names)))) if carry else docs.select(*names)

    def run(batches):
        keep, dense, b = shared.value
        row_of = np.full(SIZE, len(keep), np.int32)
        row_of[keep] = np.arange(len(keep))
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                found, n = features_of(texts)
                p = posteriors(np.stack([dense[row_of[f]].sum(0) for f in found]) + b)
                part = batch.slice(first, len(texts))
                row = pa.StructArray.from_arrays(part.columns, fields=[pa.field(n, f.type) for n, f in zip(names, part.schema, strict=True)]) if carry else part.column(0)
                yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), *(pa.array(p[:, j]) for j in range(k))], ["row" if carry else "doc_id", "n_tokens", *(f"p{j}" for j in range(k))])

    fields = [StructField("row", docs.schema) if carry else StructField("doc_id", LongType()), StructField("n_tokens", LongType()), *(StructField(f"p{j}", DoubleType()) for j in range(k))]
    return source.mapInArrow(tidy(run), StructType(fields))


def rate_column(k: int, steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rate after the steps' vectors, as one expression over ``p0 .. p(k-1)``; from 0 to ``most``."""
    rate = F.lit(1.0)
    for v in steps:
        move = sum((F.col(f"p{j}") * float(v[j]) for j in range(1, k)), F.col("p0") * float(v[0]))
        rate = F.greatest(F.lit(0.0), rate - move if most is None else F.least(F.lit(float(most)), rate - move))
    return rate


def fit_rates(
    soft: DataFrame, shares: np.ndarray, total: float | None = None, max_steps: int = 60, tolerance: float = 1e-6, bounded: np.ndarray | None = None, most: float | None = None
) -> tuple[list[np.ndarray], np.ndarray, float]:
    """The steps' vectors, the domain totals they reach and the miss that is left, for ``soft(n_tokens, p0, ...)``.

    The miss is the largest distance of a domain's total from its target, over the wanted total. With ``most``
    a rate is no greater; what lies below its target for that reason is no miss, and no step tries to raise it.

    ``total`` is the wanted number of expected tokens. Where ``bounded`` is true a share is an upper
    bound: such a domain keeps what it has below it. By default the domains that are not bounded
    keep their tokens together: without bounds, the total is that of the tokens there are.
    No domain's scarcity sets the total.
    """
    k = len(shares)
    upper = np.zeros(k, bool) if bounded is None else bounded
    sums = [F.sum(F.col("n_tokens") * F.col(f"p{j}")) for j in range(k)]
    moments = [F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
    got = np.array([x or 0.0 for x in soft.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums + moments))).first()], float)
    now, inverse = got[:k], np.linalg.pinv(got[k:].reshape(k, k), rcond=1e-12)
    if not now.sum():
        return [], now, 0.0
    if total is None:
        free = shares[~upper].sum()
        total = float(now[~upper].sum() / free) if free > 0 else float(now.sum())
    goal = np.where(upper, np.minimum(now, shares * total), shares * total)
    steps: list[np.ndarray] = []
    best = np.inf
    while True:
        miss = now - goal if most is None else np.maximum(now - goal, 0.0)
        off = float(abs(miss).max() / max(total, 1.0))
        if off < tolerance or len(steps) == max_steps or (len(steps) > 8 and off > best * (1 - 1e-4)):
            return steps, now, off
        best = min(best, off)
        steps.append(inverse @ miss)
        rate = rate_column(k, steps, most)
        got = soft.select("n_tokens", *(f"p{j}" for j in range(k)), rate.alias("r")).agg(*(F.sum(F.col("n_tokens") * F.col("r") * F.col(f"p{j}")).alias(f"s{j}") for j in range(k))).first()
        now = np.array(got, float)


def mixture(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, targets: dict[str, float] | None = None, total: float | None = None, max_rows: int = 8000, at_most: tuple[str, ...] = (), carry: bool = False,
    most: float | None = None, most_miss: float = 1e-3,
) -> tuple[DataFrame, list[str]]:
    """``(doc_id, n_tokens, p0, ..., rate)`` and the names of the domains p0, p1, ...

    With ``carry``, ``(row, n_tokens, p0, ..., rate)`` with all columns of ``docs`` in the struct
    ``row``. A domain without a labelled row in the sample cannot be told from others and is left
    out; the targets of the others are scaled to one. Targets of the domains ``at_most`` are upper
    bounds. Rates are at most ``most``. Targets that no rates reach to within ``most_miss`` of the total
    are a warning.
    """
    rows, by = labelled_sample(docs, labels, ["quality", "toxic"], 1, 1, max_rows)
    named = [DOMAINS.get((int(q > 0), int(t > 0))) for q, t in zip(by["quality"], by["toxic"], strict=True)]
    names = [n for n in DOMAINS.values() if n in named] or ["clean"]
    wanted = targets or TARGETS
    shares = np.array([wanted.get(n, 0.0) for n in names])
    shares = shares / shares.sum() if shares.sum() else np.full(len(names), 1 / len(names))
    if len(names) > 1:
        model = fit_softmax(rows, np.array([names.index(n) for n in named]), len(names))
    else:
        model = np.zeros(0, np.int32), np.zeros((1, 0)), np.zeros(1)
    del rows
    trim()
    soft = scratch.table(domain_posteriors(docs, *model, carry), "posteriors")
    steps, now, miss = fit_rates(soft, shares, total, bounded=np.array([n in at_most for n in names]), most=most)
    if miss > most_miss:
        reached = ", ".join(f"{n} {x:.0f}" for n, x in zip(names, now, strict=True))
        warnings.warn(f"rates miss the targets by {miss:.4f} of all tokens; expected totals reached: {reached}", stacklevel=2)
    return soft.withColumn("rate", rate_column(len(names), steps, most)), names


def copies(rate: Column, doc_id: Column, text: Column) -> Column:
    """Whole copies with the rate as their mean: a hash of doc_id and text decides the fraction."""
    u = F.pmod(F.xxhash64(doc_id, text, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mixed_rows(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, targets: dict[str, float] | None = None, total: float | None = None, max_rows: int = 8000, at_most: tuple[str, ...] = (), most: float | None = None
) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as its rate says.

    A rate is a function of the row's own posteriors, so nothing is joined or shuffled.
    """
    mixed, _ = mixture(docs, labels, scratch, targets, total, max_rows, at_most, carry=True, most=most)
    times = copies(F.col("rate"), F.col("row.doc_id"), F.col("row.text"))
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")
