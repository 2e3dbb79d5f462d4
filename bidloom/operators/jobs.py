"""Queues and states of ingest jobs, from their event log or job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import RANGE, ranged, running_over

TERMINAL = ["succeeded", "partial", "failed"]


def latest_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each job, with when it began and last changed."""
    return events.groupBy(key).agg(
        F.max_by(state, F.struct(*order)).alias("state"), F.min(order[0]).alias("started_at"), F.max(order[0]).alias("changed_at"), F.count("*").alias("events")
    )


def with_timeout(states: DataFrame, now: Column, limit: str = "20 minutes") -> DataFrame:
    """Jobs running for longer than ``limit`` count as failed."""
    over = (F.col("state") == "running") & (F.col("changed_at") <= now - F.expr(f"INTERVAL {limit}"))
    return states.withColumn("timed_out", over).withColumn("state", F.when(over, "failed").otherwise(F.col("state")))


def claim(queue: DataFrame, lanes: list[str], order: list[str]) -> DataFrame:
    """The oldest queued job of each lane: an aggregation, so no lane meets in a window."""
    columns = [F.col(c) for c in order] + [F.col(c) for c in queue.columns if c not in order and c not in lanes]
    return queue.groupBy(*lanes).agg(F.min(F.struct(*columns)).alias("j")).select(*lanes, "j.*")


def progress(done: Column, total: Column, state: Column) -> Column:
    return F.when(state.isin(*TERMINAL), 1.0).when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(0.99), done / total))


def retained(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Jobs that are still open or younger than ``days``."""
    return jobs.where(~F.col("state").isin(*TERMINAL) | (F.col("changed_at") > now - F.expr(f"INTERVAL {days} DAYS")))


def pulse(jobs: DataFrame, seconds: str, order: list[str], last: int = 200) -> DataFrame:
    """Median and 95th percentile of the last jobs, and the share that came from a cache."""
    recent = jobs.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    return recent.agg(
        F.count("*").alias("jobs"),
        F.count(seconds).alias("measured"),
        F.percentile(seconds, F.lit(0.5)).alias("median_s"),
        F.percentile(seconds, F.lit(0.95)).alias("p95_s"),
        (F.sum(F.col("from_cache").cast("int")) / F.count("*")).alias("cached"),
    )


def quality_rollup(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of both sources, one per source, field and message, with counts per subject."""
    every = fresh.withColumn("source", F.lit("fresh")).unionByName(stored.withColumn("source", F.lit("stored")))
    once = every.groupBy("subject", "source", "field", "message").agg(F.bool_or("affects").alias("affects"), F.min("severity").alias("severity"))
    return once.groupBy("subject").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("affects") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(F.col("affects") & (F.col("severity") == "warning")).alias("warnings"),
        F.bool_or("affects").alias("affects_confidence"),
    )


def rate_limit(requests: DataFrame, key: str, at: str, cost: str, per_second: float, capacity: float, tie: str) -> DataFrame:
    """Token bucket with debt per key: the requests with the ``wait`` in seconds that each has.

    The level after a request is a fold over the key's requests in order of ``at`` (seconds) and
    ``tie``. A fold of this form is a running maximum over prefix sums, so it is running totals
    and no state in Python: with spent S_i before request i at time t_i, the wait is what S_i + cost
    exceeds the refill by, counted from the last moment the bucket was full. Totals are taken range by
    range of (key, time) first, so a key, and an hour of it, may have any number of requests.
    """
    cut = ranged(requests, [key], [at, tie])
    rows = running_over(cut, [key], [at, tie], {"_spent": F.col(cost)})
    rows = rows.withColumn("_before", F.col("_spent") - F.col(cost))
    rows = running_over(rows, [key], [at, tie], highs={"_full": F.col(at) * per_second - F.col("_before")})
    need = F.col("_spent") + F.col("_full") - F.col(at) * per_second - capacity
    return rows.withColumn("wait", F.greatest(F.lit(0.0), need / per_second)).drop("_spent", "_before", "_full", RANGE)


def recovered(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """Jobs whose worker is gone: running with a lease that has ended.

    ``jobs(state, lease_ends_at, attempts, ...)``: such a job is queued again without a lease while it
    has attempts left, and fails otherwise. Other jobs come through as they are.
    """
    gone = F.coalesce((F.col("state") == "running") & (F.col("lease_ends_at") <= now), F.lit(False))
    tired = F.coalesce("attempts", F.lit(0)) >= max_attempts
    return jobs.withColumns({
        "state": F.when(gone & tired, "failed").when(gone, "queued").otherwise(F.col("state")),
        "lease_ends_at": F.when(~gone, F.col("lease_ends_at")),
        "recovered": gone,
    })
