"""Scoped vector retrieval, BM25 and retrieval metrics."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.questions import TOKEN, tokens
from ..session import written


def scoped(chunks: DataFrame, statuses: list[str] | None = None, sections: list[str] | None = None, **equal: object) -> DataFrame:
    """Chunks of a scope: equalities and memberships; None asks for nothing. Before any ranking."""
    out = chunks
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if statuses is not None:
        out = out.where(F.col("status").isin(*statuses))
    if sections is not None:
        out = out.where(F.col("section").isin(*sections))
    return out


#: Blocks that vectors are dealt to, and rows of a block, or of its questions, that one task multiplies at once.
PIVOTS, TILE = 64, 4096
_PLACES = 9


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError("vectors of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), sizes["max"])


def _dealt(chunks: DataFrame, pivots: np.ndarray, carry: list[str]) -> DataFrame:
    """``chunks`` with the ``block`` of the nearest pivot and the distance to it."""
    shared = chunks.sparkSession.sparkContext.broadcast(pivots)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*carry).schema.fields)

    def run(batches):
        centres = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if not len(x):
                continue
            far = np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])
            best = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.int32()), pa.array(np.sqrt(far[np.arange(len(x)), best]) + 1e-6, pa.float64())], [*batch.schema.names, "block", "far"]
            )

    return chunks.select(*carry).mapInArrow(run, f"{fields}, block int, far double")


def _asks(batch: pa.RecordBatch, centres: np.ndarray, radius: np.ndarray, numbers: np.ndarray, seed: bool):
    """Batches ``(query_id, q, block)`` of at most ``TILE`` rows: a question may ask every block, and each row holds its vector."""
    step = max(1, TILE // len(numbers))
    for start in range(0, batch.num_rows, step):
        some = batch.slice(start, step)
        q = _matrix(some.column("q"))
        most = q @ centres.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :] + 1e-6
        first = most.argmax(1)
        if seed:
            row, at = np.arange(len(q)), first
        else:
            floor = np.array([-np.inf if f is None else f for f in some.column("floor").to_pylist()])
            wanted = most >= floor[:, None]
            wanted[np.arange(len(q)), first] = False
            row, at = np.nonzero(wanted)
        asks = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([some.column("query_id").take(asks), some.column("q").take(asks), pa.array(numbers[at], pa.int32())], ["query_id", "q", "block"])


def _asking(queries: DataFrame, pivots: np.ndarray, radii: dict[int, float], seed: bool) -> DataFrame:
    """``(query_id, q, block)``: each question's most promising block, or with a ``floor`` the other blocks that may beat it.

    No vector of a block scores above the pivot's score plus the block's radius times the question's length.
    """
    blocks = np.array(sorted(radii))
    shared = queries.sparkSession.sparkContext.broadcast((pivots[blocks], np.array([radii[b] for b in blocks.tolist()]), blocks))
    fields = ", ".join(f"{n} {queries.schema[n].dataType.simpleString()}" for n in ("query_id", "q"))

    def run(batches):
        for batch in batches:
            yield from _asks(batch, *shared.value, seed)

    return queries.mapInArrow(run, f"{fields}, block int")


def _tiles(asked: DataFrame, dealt: DataFrame, block: list[str], k: int, tile: int) -> DataFrame:
    """``(query_id, chunk_id, score)``: the k best of each tile for each question that asks its block.

    A tile is some ``tile`` vectors of a block and some ``tile`` questions; both are told apart by a hash, so
    a block of a third of all vectors, or one that all questions ask, is many tiles.
    """
    n_v = dealt.groupBy(*block).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("n_v"))
    n_q = asked.groupBy(*block).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("n_q"))
    sizes = n_v.join(n_q, block)  # a row for each block
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    own = lambda side: [F.col(b).alias(f"_{side}_{b}") for b in block]  # noqa: E731  # both sides may come from one frame
    left = asked.join(sizes, block).select(*own("q"), "query_id", "q", part("query_id", "n_q").alias("_q_tile_q"), spread("n_v").alias("_q_tile_v"))
    right = dealt.join(sizes, block).select(*own("v"), "chunk_id", "embedding", part("chunk_id", "n_v").alias("_v_tile_v"), spread("n_q").alias("_v_tile_q"))
    by = lambda side: [f"_{side}_{n}" for n in [*block, "tile_q", "tile_v"]]
    kinds = [f"{n} {t.schema[n].dataType.simpleString()}" for t, n in ((asked, "query_id"), (dealt, "chunk_id"))]

    def multiply(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "score"]
        empty = pa.Table.from_arrays([questions.column("query_id").slice(0, 0), vectors.column("chunk_id").slice(0, 0), pa.array([], pa.float64())], names)
        if not questions.num_rows or not vectors.num_rows:
            return empty
        vectors = vectors.sort_by("chunk_id")  # the first of equals is the least identifier
        x, out = _matrix(vectors.column("embedding").combine_chunks()), []
        for start in range(0, questions.num_rows, 256):
            some = questions.slice(start, 256)
            scores = np.round(_matrix(some.column("q").combine_chunks()) @ x.T, _PLACES)
            if k < scores.shape[1]:
                edge = np.partition(scores, -k, axis=1)[:, -k][:, None]  # the k-th best: what is above it, and the first equals
                above, equal = scores > edge, scores == edge
                chosen = above | (equal & (equal.cumsum(1) <= k - above.sum(1)[:, None]))
            else:
                chosen = np.ones_like(scores, bool)
            row, at = np.nonzero(chosen)
            out.append(pa.Table.from_arrays([some.column("query_id").take(pa.array(row)), vectors.column("chunk_id").take(pa.array(at)), pa.array(scores[row, at], pa.float64())], names))
        return pa.concat_tables(out)

    return left.groupBy(*by("q")).cogroup(right.groupBy(*by("v"))).applyInArrow(multiply, ", ".join([*kinds, "score double"]))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, on: list[str] | None = None, min_score: float | None = None, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """The k best chunks of each query by cosine of unit vectors (any dot product), ties by chunk_id; exact, to nine decimals.

    ``queries(query_id, q, *on)`` and ``chunks(chunk_id, embedding, *on)``; ``on`` is the scope that
    both share. A question meets vectors as a matrix, and what leaves a tile is its k best.

    Without a scope, vectors are dealt to the nearest of ``pivots`` of them. A question asks its most
    promising block first; its k-th score there is a floor, and of the other blocks it asks those whose bound
    (the pivot's score and the block's radius) reaches it. Pivots and radii, a row for each block, are broadcast.
    """
    chunks = chunks.where("embedding IS NOT NULL AND chunk_id IS NOT NULL")
    asked = queries.where("q IS NOT NULL AND query_id IS NOT NULL").select("query_id", "q", *(on or []))
    if on:
        scores = _tiles(asked, chunks.select("chunk_id", "embedding", *on), on, k, tile)
        ranked = _ranked(scores, k)
    else:
        sample = chunks.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).collect()
        centres = np.array([r["embedding"] for r in sample], np.float64) if sample else np.zeros((0, 1))
        if not len(centres):
            return asked.select("query_id").join(chunks.select("chunk_id").limit(0), F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        dealt = written(_dealt(chunks, centres, ["chunk_id", "embedding"]), "blocks")
        radii = {r["block"]: r["far"] for r in dealt.groupBy("block").agg(F.max("far").alias("far")).collect()}  # one for each pivot at most
        asked = written(asked, "questions")
        seeds = written(_ranked(_tiles(_asking(asked, centres, radii, True), dealt, ["block"], k, tile), k), "seeds")
        floors = seeds.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = _asking(asked.join(floors, "query_id", "left"), centres, radii, False)
        ranked = _ranked(seeds.select("query_id", "chunk_id", "score").union(_tiles(rest, dealt, ["block"], k, tile)), k)
    ranked = ranked.select("query_id", "chunk_id", "score", "rank")
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


def nearest_of_pair(notices: DataFrame, bids: DataFrame, k: int) -> DataFrame:
    """The best k of two ranked lists, each cut to half of k (two at least); notices win ties."""
    half = max(2, k // 2)
    both = notices.where(F.col("rank") <= half).withColumn("side", F.lit(0)).unionByName(bids.where(F.col("rank") <= half).withColumn("side", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "side", "rank")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, length, t)`` of ``docs(doc_id, text)``: the number of search words and, as ``(term, tf)``, how often each comes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pattern, stop = re.compile(TOKEN), frozenset(V.BM25_STOPWORDS)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                terms, times, ends, lengths = [], [], [0], []
                for text in some.column("low").to_pylist():
                    found = Counter(pattern.findall(text))
                    for word in [w for w in found if w[-1] in ".,"]:  # a word begins with a letter or figure
                        found[word.rstrip(".,")] += found.pop(word)
                    for word in stop & found.keys():
                        del found[word]
                    terms += found.keys()
                    times += found.values()
                    ends.append(len(terms))
                    lengths.append(found.total())
                inner = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], ["doc_id", "length", "t"])

    return docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).mapInArrow(run, f"doc_id {kind}, length long, t array<struct<term: string, tf: long>>")


def _postings(docs: DataFrame, queries: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, term, w)`` of the queries' terms, and ``(query_id, term, times)``.

    Terms are counted before they meet the queries, and only the queries' terms are joined.
    """
    # Texts are taken apart once, a row for each: lengths add up from these, and documents without terms are counted apart.
    counted = written(_counted(docs), "counted")
    every = docs.agg(F.count("*").alias("n"))
    totals = every.crossJoin(counted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("terms"))).select("n", (F.col("terms") / F.nullif("n", F.lit(0))).alias("mean"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    counts = counted.select("doc_id", "length", F.explode("t").alias("t")).select("doc_id", "length", "t.term", "t.tf").join(wanted, "term", "left_semi")
    counts = written(counts.groupBy("doc_id", "length", "term").agg(F.sum("tf").alias("tf")), "counts")  # rows of one document
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.join(df, "term").crossJoin(F.broadcast(totals))
    idf = F.greatest(F.lit(1e-9), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = 1 - b + b * F.col("length") / F.coalesce(F.nullif("mean", F.lit(0.0)), F.lit(1.0))
    one = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)
    return weighed.select("doc_id", "term", one.alias("w")), asked


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, doc_id, score)`` of the documents that share a word with the query.

    ``docs(doc_id, text)``, ``queries(query_id, text)``. A word that a query holds twice counts
    twice. Every such pair is a row: for the best few of each query there is ``bm25_top``.
    """
    postings, asked = _postings(docs, queries, k1, b)
    return postings.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("times")).alias("score"))


#: Postings that one task scores at once, whole documents each.
SLICE = 500_000


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, slice_: int = SLICE, tile: int = TILE) -> DataFrame:
    """The k best of ``bm25`` with their ``rank``, ties (to six decimals) by doc_id; exact.

    The postings of some documents meet some ``tile`` questions in one task, which adds up a column of scores for
    each question; what leaves are its k best, and those that rounding may put among them. Pairs of a
    question and a document are never rows.
    """
    postings, asked = _postings(docs, queries, k1, b)
    postings, asked = written(postings, "postings"), written(asked, "asked")
    n_d = max(1, -(-postings.count() // slice_))
    n_q = max(1, -(-asked.select("query_id").distinct().count() // tile))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = postings.select(part("doc_id", n_d).alias("d"), every(n_q).alias("q"), "doc_id", "term", "w")
    right = asked.select(every(n_d).alias("d"), part("query_id", n_q).alias("q"), "query_id", F.col("term").alias("word"), "times")
    kinds = [f"{n} {t.schema[n].dataType.simpleString()}" for t, n in ((asked, "query_id"), (postings, "doc_id"))]

    def add_up(there: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not there.num_rows or not wanted.num_rows:
            return pa.Table.from_arrays([wanted.column("query_id").slice(0, 0), there.column("doc_id").slice(0, 0), pa.array([], pa.float64())], names)
        there = there.sort_by("doc_id")  # documents are numbered in their order
        doc = there.column("doc_id").combine_chunks().dictionary_encode()
        question = wanted.column("query_id").combine_chunks().dictionary_encode()
        words = wanted.column("word").combine_chunks().dictionary_encode()
        at = pc.index_in(there.column("term").combine_chunks(), value_set=words.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        number, weight = doc.indices.to_numpy(zero_copy_only=False)[order], there.column("w").combine_chunks().to_numpy(zero_copy_only=False)[order]
        ends = np.searchsorted(at[order], np.arange(len(words.dictionary) + 1))
        asks = np.argsort(question.indices.to_numpy(zero_copy_only=False), kind="stable")
        of, word, times = (c[asks] for c in (question.indices.to_numpy(zero_copy_only=False), words.indices.to_numpy(zero_copy_only=False), wanted.column("times").combine_chunks().to_numpy(zero_copy_only=False)))
        bounds = np.searchsorted(of, np.arange(len(question.dictionary) + 1))
        rows, found, scores = [], [], []
        for i in range(len(question.dictionary)):
            # A question's words in one order, so that equal texts have equal sums.
            mine = range(bounds[i], bounds[i + 1])
            docs_of = np.concatenate([number[ends[word[j]] : ends[word[j] + 1]] for j in mine])
            if not len(docs_of):
                continue
            total = np.bincount(docs_of, np.concatenate([weight[ends[word[j]] : ends[word[j] + 1]] * times[j] for j in mine]))
            some = np.flatnonzero(total > 0)
            if len(some) > k:
                some = some[total[some] >= np.partition(total[some], -k)[-k] - 2e-6]
            some = some[np.lexsort((some, -total[some]))]
            s = total[some]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            some = some[np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) < k]  # k of equal ones
            rows.append(np.full(len(some), i))
            found.append(some)
            scores.append(total[some])
        rows, found, scores = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, found, scores))
        return pa.Table.from_arrays([question.dictionary.take(pa.array(rows)), doc.dictionary.take(pa.array(found)), pa.array(scores, pa.float64())], names)

    best = left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(add_up, ", ".join([*kinds, "score double"]))
    return top(best.withColumn("score", F.round("score", 6)), k)


def top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metrics(results: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: hits at each k, precision over what came back, and the reciprocal rank.

    ``results(query_id, rank, relevant)``.
    """
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    at = [F.coalesce(F.bool_or((F.col("rank") <= k) & F.col("relevant")), F.lit(False)).cast("int").alias(f"hit_{k}") for k in ks]
    return results.groupBy("query_id").agg(*at, F.avg(F.col("relevant").cast("double")).alias("precision"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))
