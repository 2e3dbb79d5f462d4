"""A search index of chunks by owner: owners at hand replace theirs, version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .running import running
from .validation import point_id
from .versions import Versions

BUCKETS = 64
_OWN = ["bucket", "digest", "owner_digest", "point_id", "vector"]


def numbered_chunks(parts: list[DataFrame]) -> DataFrame:
    """``(owner_key, section, page_number, text, chunk_index)`` of several sources, numbered on through each owner.

    Each of ``parts(owner_key, section, page_number, place, text)`` follows the ones before it: a bid's
    document, then its narrative, then its projects' descriptions.
    """
    every = None
    for n, p in enumerate(parts):
        mine = p.select("owner_key", "section", "page_number", "place", "text", F.lit(n).alias("part"))
        every = mine if every is None else every.unionByName(mine)
    every = every.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    counted = running(every, ["owner_key"], ["part", "page_number", "place"], {"n": F.lit(1)})
    return counted.select("owner_key", "section", "page_number", "text", (F.col("n") - 1).cast("long").alias("chunk_index"))


def _state(versions: Versions) -> dict[int, tuple[int, int]]:
    """Bucket to its last version and that version's rows: one entry per bucket."""
    manifest = versions.manifest()
    if manifest is None:
        return {}
    rows = manifest.groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("m")).select("bucket", "m.*").collect()
    return {r["bucket"]: (r["version"], r["rows"]) for r in rows}


def _read(versions: Versions, state: dict[int, tuple[int, int]], buckets: set[int] | None = None) -> DataFrame | None:
    paths = [f"{versions.folder('chunks', v)}/bucket={b}" for b, (v, n) in sorted(state.items()) if n and (buckets is None or b in buckets)]
    return versions.spark.read.option("basePath", f"{versions.path}/chunks").parquet(*paths).drop("version") if paths else None


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of the last committed version of each bucket, with their vectors; None for an empty index."""
    versions = Versions(spark, path)
    found = _read(versions, _state(versions))
    return None if found is None else found.drop("bucket", "digest", "owner_digest")


def replace_owners(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], owners: DataFrame | None = None, buckets: int = BUCKETS) -> int | None:
    """Put the chunks of the owners at hand in place of theirs; the new version, or None where nothing changed.

    ``chunks(owner_key, chunk_index, text, ...)``; ``owners(owner_key)`` names owners that are to be
    replaced even if they have no chunk any more. ``embed`` takes ``(digest, text)`` and returns
    ``(digest, vector)``: it sees each distinct text once, and none that an earlier version embedded. The
    text stored is the original.

    An owner belongs to a bucket. Buckets with a changed owner are written anew, what other
    owners have in them included, under the next version; other buckets' files are not touched. An owner whose
    rows are what is stored (counts and hashes of all columns agree) is no change, so a run that is
    repeated writes nothing. A bucket that one owner fills may become many files: it is rebalanced.
    """
    spark = chunks.sparkSession
    versions = Versions(spark, path)
    state, version = _state(versions), versions.last() + 1
    payload = [c for c in chunks.columns if c not in _OWN]
    key = F.pmod(F.xxhash64("owner_key"), F.lit(buckets)).cast("int")
    new = written(chunks.select(*payload).withColumn("bucket", key).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), "new-chunks")
    row = F.xxhash64(*payload)
    sums = new.groupBy("owner_key").agg(F.xxhash64(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).alias("owner_digest"))
    given = sums.select("owner_key") if owners is None else sums.select("owner_key").union(owners.select("owner_key")).distinct()
    given = written(given.withColumn("bucket", key), "owners")
    old = _read(versions, state, {r["bucket"] for r in given.select("bucket").distinct().collect()})
    changed = given.join(sums, "owner_key", "left")
    if old is None:
        changed = changed.where("owner_digest IS NOT NULL")
    else:
        stored = old.groupBy("owner_key").agg(F.min("owner_digest").alias("stored"))
        changed = changed.join(stored, "owner_key", "left").where(~F.col("owner_digest").eqNullSafe(F.col("stored"))).drop("stored")
    changed = written(changed, "changed")
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # as many as there are buckets at most
    if not touched:
        return None
    fresh = new.join(changed.where("owner_digest IS NOT NULL").select("owner_key", "owner_digest"), "owner_key")
    texts = fresh.groupBy("digest").agg(F.min("text").alias("text"))
    known = versions.read("vectors")
    if known is not None:
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    embed(texts).select("digest", "vector").write.mode("overwrite").parquet(versions.folder("vectors", version))
    vectors = spark.read.parquet(versions.folder("vectors", version))
    if known is not None:
        vectors = vectors.unionByName(known.select("digest", "vector"))
    rows = fresh.join(vectors, "digest", "left").withColumn("point_id", point_id(F.col("owner_key"), F.col("chunk_index"))).select(*payload, *_OWN)
    if old is not None:
        rest = old.join(changed.select("owner_key"), "owner_key", "left_anti").where(F.col("bucket").isin(touched))
        rows = rows.unionByName(rest, allowMissingColumns=True)
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(versions.folder("chunks", version))
    counts = spark.read.schema(rows.schema).parquet(versions.folder("chunks", version)).groupBy("bucket").agg(F.count("*").alias("rows"))
    every = spark.createDataFrame([(b,) for b in touched], "bucket int").join(counts, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"))
    versions.commit(version, every.coalesce(1))
    return version


def payload(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """``chunks`` with ``payload``: their fields as JSON, those without a value left out."""
    return chunks.withColumn("payload", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}))


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove versions of chunks that no bucket is read from any more, once no reader is at work on them."""
    versions = Versions(spark, path)
    versions.vacuum("chunks", {v for v, _ in _state(versions).values()})
