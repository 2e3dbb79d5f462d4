"""Structured Streaming: job logs as they arrive, and windows with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import opened, shared_folder


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream: arrived files are the queue, the checkpoint the claim."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def job_states(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """The latest state of each job as a running aggregation, the same as the batch operator's."""
    return events.groupBy(key).agg(
        F.max_by(state, F.struct(at, "event_id")).alias("state"), F.min(at).alias("started_at"), F.max(at).alias("changed_at"), F.count("*").alias("events")
    )


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than ``late`` are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_epochs(target: str):
    """A ``foreachBatch`` writer: the rows that changed in an epoch are its version, written once however often it is tried."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def latest_versions(spark: SparkSession, target: str, schema, keys: list[str]) -> DataFrame:
    """The last version of each key over the epochs of ``write_epochs``."""
    found = spark.read.schema(schema).option("basePath", target).parquet(f"{target}/epoch=*")
    rest = [F.col(f.name) for f in schema.fields if f.name not in keys]
    found = found.withColumn("at", F.regexp_extract(F.input_file_name(), r"epoch=(\d+)", 1).cast("long"))
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("v")).select(*keys, "v.*").select(*schema.names)


def run_epochs(stream: DataFrame, folder: str, write=None) -> None:
    """Run a stream over what is there now, epoch by epoch into ``folder/epochs``, from where its checkpoint in ``folder`` left off.

    ``write(batch, epoch)`` writes an epoch in place of ``write_epochs``.
    """
    out = stream.writeStream.outputMode("update").foreachBatch(write or write_epochs(f"{folder}/epochs"))
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def index_decided(spark: SparkSession, states_folder: str, states_schema, key: str, chunks: DataFrame, folder: str, decided: str = "succeeded") -> None:
    """A second stream, downstream of the states that ``run_epochs`` writes: the index of a job once it is decided.

    Each epoch of ``folder/epochs`` has, for every version of a job that became ``decided`` in it, what its index
    came to: ``(key, changed_at, chunks_indexed, index_state, index_error)``. A job's chunks are
    those of ``chunks(key, text)``; one without text fails the index of that job and of no other. The
    states' files are the queue and the checkpoint the claim, so a stop between the streams, or in an
    epoch, loses no job; an epoch that is tried again is the same file set written anew.
    """
    arrived = spark.readStream.schema(states_schema).parquet(f"{states_folder}/epochs")

    def write(batch: DataFrame, epoch: int) -> None:
        ready = batch.where(F.col("state") == decided).select(key, "changed_at").distinct()
        counts = chunks.join(ready.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
        failed = F.coalesce(F.col("blank"), F.lit(0)) > 0
        result = ready.join(counts, key, "left").select(
            key, "changed_at", F.when(~failed, F.coalesce("n", F.lit(0))).alias("chunks_indexed"), F.when(failed, "failed").otherwise("ready").alias("index_state"),
            F.when(failed, F.concat(F.col("blank").cast("string"), F.lit(" chunks without text"))).alias("index_error"),
        )
        result.write.mode("overwrite").parquet(f"{folder}/epochs/epoch={epoch}")

    run_epochs(arrived, folder, write)


def patched(states: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``states`` with the index of the version that each job is in now; null where it is not decided or not yet indexed.

    ``results`` may hold a version several times, after an epoch was tried again: its rows are equal.
    """
    rest = ["chunks_indexed", "index_state", "index_error"]
    once = results.groupBy(key, "changed_at").agg(*(F.max(c).alias(c) for c in rest))
    return states.join(once, [key, "changed_at"], "left").select(*states.columns, *rest)


INDEXED = "chunks_indexed long, index_state string, index_error string"


def index_results(spark: SparkSession, folder: str, key_field: str) -> DataFrame:
    """All epochs of ``index_decided``; ``key_field`` is the key's name and type."""
    return spark.read.schema(f"{key_field}, changed_at timestamp, {INDEXED}").option("basePath", f"{folder}/epochs").parquet(f"{folder}/epochs/epoch=*")


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what is there now and return its table, one row per key.

    Changed rows go to Parquet epoch by epoch, in the folder that the executors share, as does the
    checkpoint; nothing is held on the driver.
    """
    spark = stream.sparkSession
    folder = opened(spark, f"{shared_folder(spark)}/bidloom-stream-{uuid.uuid4().hex}")
    query = stream.writeStream.outputMode("update").foreachBatch(write_epochs(f"{folder}/epochs")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_versions(spark, f"{folder}/epochs", stream.schema, keys)
