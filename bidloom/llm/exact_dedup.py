"""Exact dedup over a log-structured merge index of text digests.

The index maps the SHA-256 of a text without its ASCII white space to the row that stays.

* Memtable. Each task fills a dictionary of digests from the rows it reads and flushes it when it
  holds ``memtable_rows`` digests: one run, sorted by digest, where a digest met many times is one
  entry with its best row and its count. A hot digest therefore leaves a task as one entry.
* Filters. A run has a filter with it: the fingerprints (first sixteen bytes) of its digests and
  whether an entry has several rows. A digest asks the filters of all runs but its own by asking their
  merger, which knows in how many runs a fingerprint is: an aggregation of fingerprints, far narrower than entries.
  What more than one row may have is packed into a Bloom filter (``rowfilter``: sized by its keys, 16 MiB at
  most). An entry that it lacks is in no other run: no compaction and no lookup reads it.
* Compaction merges the other entries by key range, level by level: of at most some ``fan_in`` runs at a
  time, a range of digests is dealt to one task, put in order and merged in one pass over sorted
  entries into one run of the next level. Of equal digests the best row stays: most code points in
  the original text, then the smallest identifier; counts add up. Digests are not hashed again. The last
  level has one run for each range.
* Lookup. Every row looks itself up. A digest that the filter lacks belongs to its row alone and is
  answered without reading a run; the others are joined with the last level.
* Verification. Equal digests are only hits. The texts that the filter holds, and no others, are
  read again and dealt by ranges of (digest, row); each range compares the bytes of its
  neighbours in one pass, and only the first and last digest of a range, which may go on in the
  next one, are compared across ranges. Rows of a digest with differing bytes are regrouped by
  these bytes.

Cases. Null text counts as empty; all texts without a visible character are equal. Repeated rows
of a doc_id come back once each and all carry the same keep_id; a doc_id that is repeated with other
texts is several documents. A null doc_id sorts after every other. A very long text is one entry of
its digest like any other. An empty table gives an empty table. Further columns are ignored by
``exact_duplicates`` and kept by ``first_of_each``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowfilter import chosen_rows, filter_bits, filter_of, in_filter, maybe_in, text_hash
from .scratch import Scratch
from .textops import tidy

WHITE = b" \t\n\x0b\x0c\r"
_LAST_ID = (1 << 63) - 1
_ENTRY = pa.schema(
    [
        ("run", pa.int64()), ("head", pa.int32()), ("digest", pa.binary()), ("first", pa.int64()), ("second", pa.int64()),
        ("points", pa.int64()), ("id", pa.int64()), ("null_id", pa.bool_()), ("hash", pa.int64()), ("n", pa.int64()),
    ]
)
_ENTRY_SQL = "run long, head int, digest binary, first long, second long, points long, id long, null_id boolean, hash long, n long"
_RUNS_OF_TASK = 1 << 24
_HEAD_BITS = 16
#: Entries that a key range of one merger has, about.
RANGE_ENTRIES = 1 << 20

def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def bare(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE)


def filter_keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first sixteen bytes of each digest, as the filters take them."""
    keys = np.frombuffer(b"".join([d[:16] for d in digests]), "<i8").reshape(-1, 2)
    return keys[:, 0], keys[:, 1]


def digests_of(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """``(doc_id, hash, digest, points)`` of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            digests, points = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                digests.append(digest(bare(text)))
                points.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(points, pa.int64())], ["doc_id", "hash", "digest", "points"])

    return docs.select("doc_id", "text", text_hash().alias("hash")).mapInArrow(tidy(run), "doc_id long, hash long, digest binary, points long")


def _memtables(memtable_rows: int):
    def run(batches):
        table: dict[bytes, tuple[int, bool, int, int, int]] = {}
        number = TaskContext.get().partitionId() * _RUNS_OF_TASK

        def flush():
            keys = sorted(table)
            best = [table[k] for k in keys]
            first, second = filter_keys(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), number)), pa.array([int.from_bytes(k[:2], "big") for k in keys], pa.int32()), pa.array(keys, pa.binary()),
                    pa.array(first), pa.array(second), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.bool_()), pa.array([b[3] for b in best], pa.int64()), pa.array([b[4] for b in best], pa.int64()),
                ],
                schema=_ENTRY,
            )
            table.clear()

        for batch in batches:
            for i, h, d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = (-p, i is None, _LAST_ID if i is None else i, h)
                old = table.get(d)
                table[d] = (*new, 1) if old is None else (*min(new, old[:4]), old[4] + 1)
                if len(table) >= memtable_rows:
                    yield from flush()
                    number += 1
        if table:
            yield from flush()

    return run


def flush_runs(digests: DataFrame, memtable_rows: int = 50_000) -> DataFrame:
    """Sorted runs of ``digests(doc_id, hash, digest, points)``, numbered; ``first`` and ``second`` are the entries' fingerprints."""
    return digests.select("doc_id", "hash", "digest", "points").mapInArrow(_memtables(memtable_rows), _ENTRY_SQL)


def merged_filter(runs: DataFrame) -> DataFrame:
    """``(first, second, runs, n)``: in how many runs a fingerprint is, and the rows of its largest entry."""
    return runs.groupBy("first", "second").agg(F.count("*").alias("runs"), F.max("n").alias("n"))


def shared_filter(runs: DataFrame, scratch: Scratch) -> np.ndarray:
    """The packed filter of the fingerprints that more than one row may have."""
    shared = scratch.table(merged_filter(runs).where("runs > 1 OR n > 1").select("first", "second"), "fingerprints")
    words = filter_of(shared, filter_bits(shared.count()))
    scratch.forget(shared)
    return words


def merged_level(runs: DataFrame, ranges: int, groups: int) -> DataFrame:
    """The next level: runs of one group merged, a key range at a time. ``ranges`` is a power of two."""
    key_range = F.shiftright("head", _HEAD_BITS - ranges.bit_length() + 1)
    group = F.pmod(F.xxhash64("run"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
    dealt = runs.withColumn("range", key_range).withColumn("group", group).repartition("range", "group").sortWithinPartitions("range", "group", "digest")
    entry = F.struct((-F.col("points")).alias("p"), "null_id", "id", "hash")
    # In this order the entries of a digest are neighbours: one pass, no hash table.
    level = dealt.groupBy("range", "group", "digest").agg(F.min(entry).alias("best"), F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("head", "first", "second")))
    return level.select(F.col("group").alias("run"), "head", "digest", "first", "second", (-F.col("best.p")).alias("points"), "best.id", "best.null_id", "best.hash", "n")


def compact(runs: DataFrame, scratch: Scratch, fan_in: int = 256, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """``runs`` merged level by level, until a key range has one run."""
    size = runs.agg(F.countDistinct("run").alias("runs"), F.count("*").alias("entries")).first()
    left, ranges = size["runs"], min(1 << _HEAD_BITS, 1 << max(0, -(-size["entries"] // range_entries) - 1).bit_length())
    level = None
    while level is None or left > 1:
        left = -(-left // fan_in)
        before, level = level, scratch.table(merged_level(runs if level is None else level, ranges, left), "level")
        scratch.forget(*([before] if before is not None else []))
    return level


def asked(digests: DataFrame, words: np.ndarray) -> DataFrame:
    """``digests`` with ``maybe``: whether the filter may hold the digest."""
    shared = digests.sparkSession.sparkContext.broadcast(words)

    def probe(batches):
        for batch in batches:
            maybe = in_filter(*filter_keys(batch.column(2).to_pylist()), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], [*batch.schema.names, "maybe"])

    return digests.select("doc_id", "hash", "digest", "points").mapInArrow(probe, "doc_id long, hash long, digest binary, points long, maybe boolean")


def lookup(digests: DataFrame, level: DataFrame, words: np.ndarray) -> DataFrame:
    """``digests`` with ``(keep_id, keep_hash, group_size)`` from an index; null where it has no such digest.

    Digests that the filter ``words`` lacks are answered without reading the level.
    """
    probed = asked(digests, words)
    answer = level.select("digest", F.when(~F.col("null_id"), F.col("id")).alias("keep_id"), F.col("hash").alias("keep_hash"), F.col("n").alias("group_size"))
    none = [F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_hash", "group_size")]
    return probed.where("maybe").drop("maybe").join(answer, "digest", "left").select("doc_id", "hash", "digest", "points", "keep_id", "keep_hash", "group_size").union(
        probed.where("NOT maybe").select("doc_id", "hash", "digest", "points", *none)
    )


def bodies_of(docs: DataFrame, words: np.ndarray, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """``(doc_id, hash, digest, points, body)`` of the rows whose digest the filter may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            bodies = [bare(t) for t in texts]
            found = [digest(b) for b in bodies]
            hit = np.flatnonzero(in_filter(*filter_keys(found), shared.value))
            some = pa.array(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(some), batch.column(2).take(some), pa.array([found[i] for i in hit], pa.binary()),
                    pa.array([len(texts[i]) for i in hit], pa.int64()), pa.array([bodies[i] for i in hit], pa.binary()),
                ],
                ["doc_id", "hash", "digest", "points", "body"],
            )

    return docs.select("doc_id", "text", text_hash().alias("hash")).mapInArrow(tidy(run), "doc_id long, hash long, digest binary, points long, body binary")


def _neighbours(batches):
    """Of sorted ``(digest, body)``: digests whose bytes differ, and the bodies at the range's ends."""
    made = pa.schema([("digest", pa.binary()), ("differs", pa.bool_()), ("body", pa.binary())])
    key = first = None
    differs, at_start = False, True
    for batch in batches:
        out = []
        for d, b in zip(batch.column(0), batch.column(1), strict=True):
            d, b = d.as_py(), b.as_py()
            if d != key:
                if key is not None and (differs or at_start):
                    out.append({"digest": key, "differs": differs, "body": first if at_start else None})
                at_start = key is None
                key, first, differs = d, b, False
            elif not differs and b != first:
                differs = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=made)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"digest": key, "differs": differs, "body": first}], schema=made)


def differing_digests(bodies: DataFrame) -> DataFrame:
    """Digests of ``bodies(digest, body, ...)`` under which the bytes are not all equal."""
    dealt = bodies.select("digest", "body", F.monotonically_increasing_id().alias("row")).repartitionByRange("digest", "row").sortWithinPartitions("digest", "row")
    found = dealt.select("digest", "body").mapInArrow(_neighbours, "digest binary, differs boolean, body binary")
    across = found.groupBy("digest").agg(F.max("differs").alias("differs"), F.min("body").alias("low"), F.max("body").alias("high"))
    return across.where("differs OR low <> high").select("digest")


def grouped(docs: DataFrame, scratch: Scratch, memtable_rows: int = 50_000, digest: Callable[[bytes], bytes] = sha256, fan_in: int = 256) -> DataFrame:
    """``(doc_id, hash, digest, keep_id, keep_hash, group_size)`` for every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    digests = scratch.table(digests_of(docs, digest), "digests")
    runs = scratch.table(flush_runs(digests, memtable_rows), "runs")
    words = shared_filter(runs, scratch)
    level = compact(runs.where(maybe_in(words, runs.sparkSession)("first", "second")), scratch, fan_in)
    scratch.forget(runs)
    bodies = scratch.table(bodies_of(docs, words, digest), "bodies")
    differing = scratch.table(differing_digests(bodies), "differing")
    # A digest of one row, whether the filter lacks it or not, is answered by the row itself.
    alone = F.col("group_size").isNull()
    out = lookup(digests, level, words).select(
        "doc_id", "hash", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("hash")).otherwise(F.col("keep_hash")).alias("keep_hash"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    if differing.isEmpty():
        scratch.forget(bodies, differing)
        return out
    # Two texts with one digest: these rows, read with all they need, are grouped by their bytes.
    clash = bodies.join(differing, "digest", "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), "hash"))
    best = clash.groupBy("digest", "body").agg(best.alias("b"), F.count("*").alias("group_size"))
    regrouped = clash.join(best, ["digest", "body"]).select("doc_id", clash["hash"], "digest", F.col("b.id").alias("keep_id"), F.col("b.hash").alias("keep_hash"), "group_size")
    return out.join(differing, "digest", "left_anti").select(*regrouped.columns).union(regrouped)


def exact_duplicates(docs: DataFrame, scratch: Scratch, memtable_rows: int = 50_000, digest: Callable[[bytes], bytes] = sha256, fan_in: int = 256) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text)``."""
    return grouped(docs, scratch, memtable_rows, digest, fan_in).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def first_of_each(docs: DataFrame, scratch: Scratch, memtable_rows: int = 50_000, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns."""
    found = grouped(docs, scratch, memtable_rows, digest)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
    return chosen_rows(docs, found.select(F.col("doc_id").alias("id"), "hash", stays.alias("stays")), scratch)
