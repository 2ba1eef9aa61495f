"""Continuous cache upsert and request limits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache


def upsert_stream(updates: DataFrame, root: str, checkpoint: str, *tie: str) -> StreamingQuery:
    """Append the accepted rows of each batch to a log below ``root``; ``read_cache`` gives the newest rows.

    A batch is a folder of its own, named by the query's id and the batch's number: a batch that is
    repeated writes the same folder again, and a query with a new checkpoint adds to the log beside
    what earlier ones wrote.
    """
    columns = [c for c in updates.columns if c != "status"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        named = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        path = f"{root}/query={json.loads(named)['id']}/batch={batch_id}"
        cache.acceptable(batch).select(*columns).write.mode("overwrite").parquet(path)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cache(spark: SparkSession, root: str, *tie: str) -> DataFrame:
    """The newest row of each key over all batches of all queries that wrote to ``root``."""
    return cache.newest(spark.read.parquet(root).drop("query", "batch"), *tie)


def rate_stream(requests: DataFrame, limit: int = 60, minutes: int = 1, late: str = "5 minutes") -> DataFrame:
    """Clients over the limit per minute; windows close once the watermark passes."""
    return (
        requests.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minute"), "client")
        .agg(F.count("*").alias("n_requests")).filter(F.col("n_requests") > limit)
        .select(F.col("window.start").alias("window_start"), "client", "n_requests")
    )
