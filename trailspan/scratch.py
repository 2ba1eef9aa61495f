"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and outlives lost executors. What is written inside ``scratch`` is deleted at its
end; the rest goes when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scopes: list[list[tuple[str, str]]] = []


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the session's JVM ends, if no scope does before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, store = _hadoop(spark, path)
    store.deleteOnExit(place)
    if _scopes:
        _scopes[-1].append((name, path))
    return path


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Deletes at its end what was written inside, but for tables of the names in ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for name, path in _scopes.pop():
            if name in keep:
                if _scopes:
                    _scopes[-1].append((name, path))
                continue
            place, store = _hadoop(spark, path)
            store.delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
