"""A training-corpus pipeline of five stages over ``documents``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that has to be written before the
next stage begins: working tables of a stage are removed when the next one starts. All but the last
return the columns of ``documents``.

Cases, for every stage. A null text counts as empty. A null doc_id is a document like any other, but
that near dedup leaves it as it is. A doc_id that is repeated with other texts is several
documents, each judged by its own text. Very long texts are read whole. An empty table
gives an empty table. Further columns come through, whatever their names. By stage:

* quality: without labels of both classes everything stays; rows that are repeated share their fate.
* exact dedup: of equal texts the longest original stays, then the smallest doc_id, then the
  smallest hash of the original; of a row that is repeated one copy stays. All texts without a
  visible character are one group.
* near dedup: of a component the smallest doc_id stays. A text without words links with nothing
  and stays; a row that is repeated comes through once.
* mixing: a row stays or goes, and has no second copy; rows that are repeated share their fate;
  without labels every row stays.
* pieces: one row out for each row in; a null text has null tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import exact_dedup as exact
from bidloom.llm import near_dedup as near
from bidloom.llm.mixing import UNWANTED, mixed_rows
from bidloom.llm.pieces import default_model, encode_documents
from bidloom.llm.quality import keep_good
from bidloom.llm.scratch import Scratch

_open: list[Scratch] = []


def _stage(spark: SparkSession) -> Scratch:
    """Working tables of this stage; those of the stage before are removed."""
    while _open:
        before = _open.pop()
        if before.spark is spark:
            before.drop()
    _open.append(Scratch(spark))
    return _open[-1]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _stage(spark)
    return keep_good(docs, _labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.first_of_each(docs, _stage(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at five-word shingle similarity 0.8 or more."""
    return near.first_of_each(docs, _stage(spark), shingle_words=5, per_hundred=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, once at most; unwanted domains with too many tokens shrink.

    Earlier stages have removed most junk, so what is left of it, however little, is no measure of
    the mixture: targets of unwanted domains are upper bounds, and clean tokens keep their number.
    """
    return mixed_rows(docs, _labels(spark, sf_dir), _stage(spark), at_most=UNWANTED, most=1.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of each document's best path, and whether decoding each of its four best gives the text."""
    _stage(spark)
    encoded = encode_documents(docs, default_model(), n=4)
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.element_at("scores", 1).alias("score"), "decoded")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mixing),
    ("SentencePiece encoding", pieces),
]

#: The classifier and the fitted rates have no SQL form; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    between = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        written = between.table(stage(spark, docs, sf_dir), name.split()[0])
        between.forget(last)
        docs = last = written
    return docs
