"""MinHash near-dedup by min-max hashing.

Each permutation of a document's shingles gives two signature values, its minimum and its
maximum, so ``permutations`` hash evaluations make ``2 * permutations`` unbiased values. Bands
of ``band_rows`` values are bucket keys. The buckets only propose pairs: every link is confirmed
on the full shingle sets of both texts.

How large groups are kept linear. Documents with equal shingle sets are one class, named by
its smallest doc_id and a part of the set's digest, so that two texts under one doc_id are two classes. In a bucket, every class is compared with one pivot; classes that linked are
one component, and a bucket whose classes are one component is settled. Of the other buckets, each
class outside the bucket's largest component asks for partners. It finds them by prefix filtering,
which is exact: order shingles from rare to frequent, and two sets that link share one of their
first few shingles, early enough in both that what follows can still reach the threshold. A near
copy with too many shingles of its own thus meets nobody, however large its group. The pairs found
are confirmed, so no link that the bands proposed is lost, and nothing is capped. What this costs:
an asker meets those of its size class with which it shares one of its first shingles, so a
family of unlinked near misses in which each member shares rare shingles with many others meets in
as many pairs as these shingles make; shingles that the whole family shares come last in the order.

Only texts of classes that met another are shuffled: the others fail a filter where they are read.

Cases. A null or empty text, or one without words, has no shingles and links with nothing. A text
of fewer words than a shingle has one shingle, of all its words; a very long text is one set like
any other. Rows that repeat a doc_id and its text come back once each, in one component. Rows that
repeat a doc_id with other texts are documents of their own: each has the component of its own
text. A null doc_id comes back as its own row with a null component. An empty table gives an empty
table. Further columns are ignored by ``near_duplicates`` and kept by ``first_of_each``, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .rowfilter import chosen_rows, filter_bits, filter_of, maybe_in, row_keys, text_hash
from .scratch import Scratch
from .textops import mix, shingle_set, slices, tidy, words_of

_U = np.uint64


class MinMaxHasher:
    """Signatures and band keys of shingle sets."""

    def __init__(self, permutations: int = 48, band_rows: int = 4, seed: int = 7):
        if 2 * permutations % band_rows:
            raise ValueError("band_rows has to divide the 2 * permutations signature values")
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
        self.factor, self.shift = draw(permutations), draw(permutations)
        self.weights, self.band_rows = draw(band_rows), band_rows
        self.band_salt = draw(2 * permutations // band_rows)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation, side by side."""
        low = high = None
        for at in range(0, len(shingles), 20_000):
            h = shingles[None, at : at + 20_000] * self.factor[:, None] + self.shift[:, None]
            a, b = h.min(1), h.max(1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.stack([low, high], 1).ravel()

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(-1, self.band_rows)
        return mix((mix(rows) * self.weights).sum(1, dtype=np.uint64) + self.band_salt).view(np.int64)


def _signer(k: int, hasher: MinMaxHasher):
    names = ["doc_id", "hash", "n_shingles", "set_a", "set_b", "bands"]

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words, at, _ = words_of(texts)
                sizes, a, b, bands = [], [], [], []
                for i in range(len(texts)):
                    s = shingle_set(words[at[i] : at[i + 1]], k)
                    sizes.append(len(s))
                    a.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    bands.append(hasher.bands(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        batch.column(2).slice(first, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names,
                )

    return tidy(run)


def _confirmer(k: int, per_hundred: int):
    """Pairs ``(a, b, text_a, text_b)`` whose full sets reach the threshold, decided in integers."""

    def run(batches):
        held: dict[bytes, np.ndarray] = {}  # by text: sets of pivots come again and again

        def set_of(text: bytes) -> np.ndarray:
            if (s := held.get(text)) is None:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[text] = s = shingle_set(words_of([text])[0], k)
            return s

        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = set_of((x.as_py() or "").encode()), set_of((y.as_py() or "").encode())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= per_hundred * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return tidy(run)


def _shingle_rows(k: int):
    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words, at, _ = words_of(texts)
                sets = [shingle_set(words[at[i] : at[i + 1]], k) for i in range(len(texts))]
                owner = np.repeat(np.arange(first, first + len(texts)), [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64)
                for at_row in range(0, len(flat), 100_000):
                    of = batch.column(0).take(pa.array(owner[at_row : at_row + 100_000]))
                    yield pa.RecordBatch.from_arrays([of, pa.array(flat[at_row : at_row + 100_000])], ["doc", "token"])

    return tidy(run)


_NODE = "struct<id:bigint,tag:bigint>"


def prefix_pairs(texts: DataFrame, members: DataFrame, scratch: Scratch, shingle_words: int, per_hundred: int) -> DataFrame:
    """Pairs ``(a, b)``, a > b, that may link, of ``members(doc, n, component, asks)`` and ``texts(node, text)``.

    Of each pair one side asks and the components differ. A shingle of rank r (1: the rarest) in a
    set of n leaves n - r + 1 shingles from there on; at the first shingle that two sets share, the
    smaller such rest bounds the intersection, which has to reach t / (1 + t) of the sizes' sum. A
    set of n therefore looks, for partners of about a given size, at so many of its first shingles
    only, and the size class of the partner is part of the join key.
    """
    t = per_hundred / 100.0
    rows = texts.join(members.select(F.col("doc").alias("node")), "node").select("node", "text").mapInArrow(_shingle_rows(shingle_words), f"doc {_NODE}, token long")
    frequency = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(frequency, "token").join(members, "doc")
    of_doc = Window.partitionBy("doc")
    # Shingles of one set only take the first ranks and meet nobody, so only their number counts.
    ranked = shared.withColumn("shared", F.count("*").over(of_doc)).withColumn("place", F.row_number().over(of_doc.orderBy("df", "token")))
    ranked = ranked.withColumn("rest", F.col("shared") - F.col("place") + 1)
    ranked = ranked.where(100 * F.col("rest") >= int(per_hundred) * F.col("n")).select("token", "doc", "n", "rest", "component", "asks")
    ranked = scratch.table(ranked, "prefixes")  # both sides of the join read it
    step = 1.03
    size_class = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(step)))
    largest = F.least(F.col("rest") * ((1 + t) / t) - F.col("n") + 1e-6, F.col("n") / t + 1e-6)
    first, last = size_class(F.greatest(F.col("n") * t - 1e-6, F.lit(1.0))), size_class(F.greatest(largest, F.lit(1.0)))
    asking = ranked.where("asks").where(first <= last).select(
        "token", F.explode(F.sequence(first, last)).alias("class"), F.col("doc").alias("x"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"), F.col("component").alias("own")
    )
    asked = ranked.select("token", size_class(F.col("n")).alias("class"), "doc", "n", "rest", "component")
    enough = f"{100 + per_hundred} * least(rest, rest_x) >= {int(per_hundred)} * (n + n_x)"
    met = asking.join(asked, ["token", "class"]).where(f"component <> own AND {enough}")
    return met.select(F.greatest("x", "doc").alias("a"), F.least("x", "doc").alias("b")).distinct()


def _texts_of(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, text)`` of ``classes(node, hash)``; texts that the classes' filter lacks are not shuffled."""
    wanted = classes.select(F.col("node.id").alias("id"), "hash", "node")
    maybe = maybe_in(filter_of(wanted.select(*row_keys()), filter_bits(wanted.count())), docs.sparkSession)
    some = docs.select(F.col("doc_id").alias("id"), text_hash().alias("hash"), "text").where(F.col("id").isNotNull() & maybe(*row_keys()))
    some = some.groupBy("id", "hash").agg(F.first("text").alias("text"))  # a row may be repeated
    return scratch.table(some.join(wanted, ["id", "hash"]).select("node", "text"), "texts")


def components_of(
    docs: DataFrame, scratch: Scratch, shingle_words: int = 5, per_hundred: int = 80, permutations: int = 48, band_rows: int = 4, seed: int = 7
) -> DataFrame:
    """``(doc_id, hash, n_shingles, component_id, stays)`` for every row of ``docs(doc_id, text)``.

    ``stays`` names one text of each component: of its smallest class, that with the smallest
    doc_id and hash.
    """
    docs = docs.select("doc_id", "text")
    hasher = MinMaxHasher(permutations, band_rows, seed)
    signed = docs.select("doc_id", "text", text_hash().alias("hash")).mapInArrow(
        _signer(shingle_words, hasher), "doc_id long, hash long, n_shingles long, set_a long, set_b long, bands array<long>"
    )
    signed = scratch.table(signed, "signed")
    same = ["set_a", "set_b", "n_shingles"]
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # The bands are those of the set, so they are the same in every row of a class.
    classes = some.groupBy(*same).agg(F.min(F.struct("doc_id", "hash")).alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.table(
        classes.select(*same, F.struct(F.col("rep.doc_id").alias("id"), F.col("set_a").alias("tag")).alias("node"), F.col("rep.hash").alias("hash"), "bands"), "classes"
    )

    banded = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot <> top").drop("top")
    full = scratch.table(full, "full")  # so that a bucket with very many rows can be split in the join
    placed = scratch.table(banded.join(full, "bucket").select("bucket", F.col("node").alias("doc"), F.col("n_shingles").alias("n"), "pivot"), "buckets")
    scratch.forget(full)

    met = placed.select(F.col("doc").alias("node")).distinct()
    met = scratch.table(classes.select("node", "hash").join(met, "node", "left_semi"), "met")
    texts = _texts_of(docs, met, scratch)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.table(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(shingle_words, per_hundred), f"a {_NODE}, b {_NODE}"), "links")

    sizes = placed.select(F.col("doc").alias("pivot"), F.col("n").alias("n_pivot")).distinct()
    near = f"100 * least(n, n_pivot) >= {int(per_hundred)} * greatest(n, n_pivot)"
    tried = scratch.table(
        placed.where("doc <> pivot").select("doc", "n", "pivot").distinct().join(sizes, "pivot").where(near)
        .select(F.col("doc").alias("a"), F.col("pivot").alias("b")),
        "pairs",
    )
    labels = connected_components(confirmed(tried), scratch)

    known = labels.select(F.col("node").alias("doc"), "component")
    members = placed.select("bucket", "doc", "n").join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    open_ = (
        counts.groupBy("bucket")
        .agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("bucket", "main")
    )
    open_ = scratch.table(open_, "open")
    unsettled = scratch.table(
        members.join(open_, "bucket").groupBy("doc", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("asks")), "unsettled"
    )
    scratch.forget(placed, open_)
    pairs = scratch.table(prefix_pairs(texts, unsettled, scratch, shingle_words, per_hundred).join(tried, ["a", "b"], "left_anti"), "pairs")
    labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(confirmed(pairs)), scratch)
    scratch.forget(texts, unsettled, tried, pairs, met)

    ends = classes.select(*same, "node", "hash").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = scratch.table(ends.withColumnRenamed("hash", "rep_hash"), "ends")
    keyed = signed.select("doc_id", "hash", *same).join(ends, same, "left")
    known = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    return keyed.select(
        "doc_id",
        "hash",
        "n_shingles",
        F.when(known, F.col("component.id")).when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"),
        F.when(known, (F.col("node") == F.col("component")) & (F.col("doc_id") == F.col("node.id")) & (F.col("hash") == F.col("rep_hash"))).otherwise(F.lit(True)).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame, scratch: Scratch, shingle_words: int = 5, per_hundred: int = 80, permutations: int = 48, band_rows: int = 4, seed: int = 7
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Two documents link when 100 * |shared shingles| >= per_hundred * |union|. ``kept`` tells that
    doc_id is the component's.
    """
    found = components_of(docs, scratch, shingle_words, per_hundred, permutations, band_rows, seed)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, scratch: Scratch, shingle_words: int = 5, per_hundred: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns; null doc_ids and texts without words stay."""
    found = components_of(docs, scratch, shingle_words, per_hundred)
    return chosen_rows(docs, found.select(F.col("doc_id").alias("id"), "hash", "stays"), scratch)
