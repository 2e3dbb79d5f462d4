"""Sources: document files, answer keys, bronze records; and the matching sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = ["pdf", "docx"]

PAGES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    ]
)
ANSWER_KEY = "vendor_id string, notification_id string, intended_status string, intended_reason string, intended_failed_clause string, intended_ground string, is_blacklisted boolean, file_name string"


def document_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files that a parser can read, and rejected files with the reason, by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.withColumn("suffix", suffix)
    good = files.where(F.col("suffix").isin(*SUPPORTED)).withColumn("content_hash", F.sha2("content", 256))
    bad = files.where(~F.col("suffix").isin(*SUPPORTED)).select(
        "path", F.when(F.col("suffix") == "doc", "convert .doc to .docx").otherwise(F.concat(F.lit("unsupported: "), F.col("suffix"))).alias("reason")
    )
    return good, bad


def parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that a parser wrote as JSON lines, against the fixed schema; malformed rows fail."""
    return spark.read.schema(PAGES).option("mode", "FAILFAST").json(path)


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """The labelled answer key; a vendor without id, twice, or of unknown status raises."""
    rows = spark.read.csv(path, header=True, schema=ANSWER_KEY)
    bad = rows.where("vendor_id IS NULL OR intended_status NOT IN ('pass', 'eliminate')").isEmpty() is False
    twice = not rows.groupBy("vendor_id").count().where("count > 1").isEmpty()
    if bad or twice:
        raise ValueError("the answer key holds a vendor twice, without id or of unknown status")
    return rows


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled question of a JSON file ``{queries: [...]}``."""
    return spark.read.json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def store_by_hash(files: DataFrame, path: str) -> None:
    """Content-addressed copies: one row per digest, in folders by the digest's first byte."""
    unique = files.select("content_hash", "content").dropDuplicates(["content_hash"])
    unique.withColumn("shard", F.substring("content_hash", 1, 2)).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def replace_by_owner(chunks: DataFrame, path: str, owner: str = "owner_key") -> None:
    """Chunks of the owners at hand replace theirs; other owners' partitions stay."""
    chunks.repartition(owner).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)
