"""Job, failure, cache and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .newest import first_rows

# --- Fixed values: states, times to live, limits and failure words ------------------
STATES = ["queued", "running", "done", "error"]
JOB_TTL_DAYS = 7
ENGINE_FAILURE = r"(?i)(access denied|captcha|too many requests|http protocol error|timed out|network|forbidden)"
FAILURE_THRESHOLD, COOLDOWN_MINUTES = 2, 30
CACHE_TTL_SECONDS = {"overpass": 86_400, "search": 604_800, "geocode": 2_592_000}


def latest_state(log: DataFrame, *tie: str) -> DataFrame:
    """Last change of each job."""
    return first_rows(log, ["job_id"], ["updated_at", *tie], last=True)


def job_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    """Jobs per state as columns; a state without jobs counts 0."""
    return jobs.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def latest_jobs(jobs: DataFrame, n: int = 20, order: str = "created_no") -> DataFrame:
    """The ``n`` newest jobs, newest first."""
    return jobs.orderBy(F.desc(order)).limit(n)


def prune(jobs: DataFrame, as_of: str, ttl_days: int = JOB_TTL_DAYS) -> DataFrame:
    """Drop finished jobs whose last change is older than the time to live."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{ttl_days}' DAY")
    return jobs.filter(~(F.col("status").isin("done", "error") & (F.col("updated_at") < cutoff)))


def failure_report(failures: DataFrame) -> DataFrame:
    """Failures, most attempts and last error per source and URL."""
    return failures.groupBy("source", "url").agg(
        F.count("*").alias("n_failures"), F.max("attempts").alias("max_attempts"),
        F.max_by("lastError", "failedAt").alias("last_error"),
    )


def request_cache_stats(requests: DataFrame) -> DataFrame:
    """Keys, hits and misses per cache, from requests marked ``is_miss``."""
    return requests.groupBy("cache").agg(
        F.count_distinct("key").alias("n_keys"), F.count_if(~F.col("is_miss")).alias("hits"),
        F.count_if("is_miss").alias("misses"),
    )


def engine_events(log: DataFrame) -> DataFrame:
    """Successes and recognised failures; other reasons do not count."""
    return log.filter(F.col("success") | F.coalesce(F.col("reason").rlike(ENGINE_FAILURE), F.lit(False)))


def engine_health(log: DataFrame, as_of: str | Column) -> DataFrame:
    """State of each engine after its last event.

    ``failures`` since the last success; from two on the engine is suspended until
    30 minutes after the last one. Two aggregates, both combined on the map side.
    """
    events = engine_events(log)
    at = F.struct("ts", "seq")
    last_ok = events.groupBy("engine").agg(
        F.max(F.when(F.col("success"), at)).alias("_ok"),
        F.max_by(F.col("reason"), F.when(~F.col("success"), at)).alias("last_reason"),
    )
    since = (
        events.filter(~F.col("success")).join(last_ok.select("engine", "_ok"), "engine")
        .filter(F.col("_ok").isNull() | (at > F.col("_ok")))
        .groupBy("engine").agg(F.count("*").alias("failures"), F.max("ts").alias("_last"))
    )
    until = F.when(F.col("failures") >= FAILURE_THRESHOLD, F.col("_last") + F.expr(f"INTERVAL '{COOLDOWN_MINUTES}' MINUTE"))
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return (
        last_ok.join(since, "engine", "left").withColumn("suspended_until", until)
        .select(
            "engine", F.coalesce("failures", F.lit(0)).alias("failures"), "suspended_until", "last_reason",
            F.coalesce(F.col("suspended_until") > now, F.lit(False)).alias("is_suspended"),
        )
    )


def rate_windows(requests: DataFrame, limit: int = 60, minutes: int = 1) -> DataFrame:
    """Requests per client and minute beyond the limit. Works on streams, too."""
    counted = requests.groupBy(F.window("ts", f"{minutes} minute"), "client").agg(F.count("*").alias("n_requests"))
    return counted.filter(F.col("n_requests") > limit).select(
        F.col("window.start").alias("window_start"), "client", "n_requests"
    )
