"""Batches of files in which some are broken: good rows go on, errors become rows, no file fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: the lines of all files under ``path``; ``file`` is the path below it. Unreadable files are left out and reported by ``unreadable``."""
    lines = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
    return lines.select(_below(F.input_file_name(), path).alias("file"), "value")


def _below(name: Column, path: str) -> Column:
    return F.regexp_replace(F.url_decode(name), r"^.*/\Q" + path.rstrip("/").rsplit("/", 1)[-1] + r"\E/", "")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes)`` of all files with a byte under ``path``, whether they can be read or not; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(_below(F.col("path"), path).alias("file"), F.col("length").alias("bytes"))


def parsed(lines: DataFrame, schema: T.StructType, required: list[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """``lines(file, value)`` with ``record``, and ``kind`` and ``message`` of the first thing wrong with them, null for good rows.

    A line that is no JSON object is ``malformed``; one with a value of another type ``wrong type``; one without a
    required field ``missing``, with the fields' names; one that a check of ``checks`` (name to a condition on ``record``) does not
    pass is of that kind. Blank lines are no rows.
    """
    held = lines.where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    whole = F.try_parse_json("value")
    read = held.select("file", "value", whole.alias("_whole"), F.from_json("value", wide, options).alias("_read"))
    is_object = F.coalesce(F.schema_of_variant("_whole").startswith("OBJECT"), F.lit(False))
    absent = F.array_compact(F.array(*(F.when(F.col(f"_read.{c}").isNull(), F.lit(c)) for c in required))) if required else F.array().cast("array<string>")
    record = F.struct(*(F.col(f"_read.{f.name}").alias(f.name) for f in schema.fields))
    rows = read.select("file", "value", record.alias("record"), is_object.alias("_object"), F.col(f"_read.{_CORRUPT}").isNotNull().alias("_wrong"), absent.alias("_absent"))
    kind = F.when(~F.col("_object"), "malformed").when(F.col("_wrong"), "wrong type").when(F.size("_absent") > 0, "missing")
    message = F.when(~F.col("_object"), F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80)))
    message = message.when(F.col("_wrong"), F.concat(F.lit("a field is of another type: "), F.substring("value", 1, 80))).when(F.size("_absent") > 0, F.concat(F.lit("missing: "), F.array_join("_absent", ", ")))
    for name, holds in (checks or {}).items():
        kind = kind.when(~F.coalesce(holds, F.lit(False)), name)
        message = message.when(~F.coalesce(holds, F.lit(False)), F.concat(F.lit("does not hold: "), F.lit(name)))
    return rows.select("file", "value", "record", kind.alias("kind"), message.alias("message"))


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where("kind IS NULL").select("file", "record.*")


def quarantined(rows: DataFrame) -> DataFrame:
    """``(file, kind, message, value)`` of the rows that are set aside."""
    return rows.where("kind IS NOT NULL").select("file", "kind", "message", "value")


def report(rows: DataFrame, lines: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """Per file: rows, good rows, rows of each kind of error, an example, and a status.

    ``ok`` has no error, ``partial`` some, ``failed`` no good row, ``empty`` blank lines only and ``unreadable``
    no line at all. Spark does not list files of no bytes, so they are not in ``files``.
    """
    column = lambda k: k.replace(" ", "_")
    seen = rows.groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if(F.col("kind").isNull()).alias("good"), *(F.count_if(F.col("kind") == k).alias(column(k)) for k in kinds), F.min("message").alias("example")
    )
    counts = ["lines", "rows", "good", *map(column, kinds)]
    every = files.join(lines.groupBy("file").agg(F.count("*").alias("lines")), "file", "left").join(seen, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    status = F.when(F.col("lines") == 0, "unreadable").when(F.col("rows") == 0, "empty").when(F.col("good") == F.col("rows"), "ok").when(F.col("good") > 0, "partial").otherwise("failed")
    return every.select("file", "bytes", *counts, "example", status.alias("status"))


def inspect(pages: DataFrame) -> DataFrame:
    """What parsing alone gives, a row per page: characters, tables and the first 100 characters without runs of white space."""
    text = F.coalesce("text", F.lit(""))
    return pages.select(
        "doc_id", "page_number", F.length(text).alias("chars"), "method", F.greatest(F.coalesce(F.size("tables"), F.lit(0)), F.lit(0)).alias("tables"),
        F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 100).alias("preview"),
    )
