"""Originals kept by content: rows that name a file without its digest get both, again and again without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import Versions
from ..session import written


def stored_digests(spark: SparkSession, path: str) -> DataFrame | None:
    """``(content_hash, bytes, version)`` of all contents that are there whole."""
    return Versions(spark, path).manifest()


def stored_contents(spark: SparkSession, path: str) -> DataFrame | None:
    """``(content_hash, content)`` of the committed versions."""
    found = Versions(spark, path).read("content")
    return None if found is None else found.select("content_hash", "content")


def backfill(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``rows(name, source_file, content_hash)`` with ``content_hash`` and ``outcome``: already, stored or missing.

    ``files(source_file, content)``, each file once. Rows that have a digest stay as they are. Of the others, the
    contents of files that still exist are written once per digest, those that an earlier run stored not again;
    the manifest is written last, so a run that breaks leaves no half entry and can be repeated. Contents
    move once, to be one per digest; a run that finds nothing new writes nothing. A row whose file is
    gone is reported and left alone.
    """
    spark, versions = rows.sparkSession, Versions(rows.sparkSession, path)
    wanted = rows.where("content_hash IS NULL AND source_file IS NOT NULL").select("source_file").distinct()
    digests = files.join(wanted, "source_file", "left_semi").select("source_file", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    digests = written(digests, "digests")
    known = stored_digests(spark, path)
    fresh = digests.select("digest", "bytes", "source_file")
    if known is not None:
        fresh = fresh.join(known.select(F.col("content_hash").alias("digest")), "digest", "left_anti")
    # One file stands for each digest, so that equal contents are not moved at all.
    fresh = written(fresh.groupBy("digest").agg(F.min("source_file").alias("source_file"), F.min("bytes").alias("bytes")), "fresh")
    if not fresh.isEmpty():
        version = versions.last() + 1
        contents = files.join(fresh.select("source_file", "digest"), "source_file").select(F.col("digest").alias("content_hash"), F.col("content").cast("binary").alias("content"))
        contents.write.mode("overwrite").parquet(versions.folder("content", version))
        versions.commit(version, fresh.select(F.col("digest").alias("content_hash"), "bytes"))
    found = rows.join(digests.select("source_file", "digest"), "source_file", "left")
    outcome = F.when(F.col("content_hash").isNotNull(), "already").when(F.col("digest").isNotNull(), "stored").otherwise("missing")
    return found.select("name", "source_file", F.coalesce("content_hash", "digest").alias("content_hash"), outcome.alias("outcome"))
