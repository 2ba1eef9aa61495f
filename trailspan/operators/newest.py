"""First rows by an order, decided on narrow columns.

A wide row in an aggregate (``min_by`` of a struct) makes Spark sort and shuffle rows with their texts. Here the
order alone is aggregated, which Spark combines before the shuffle, and only the rows that won are fetched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, key: Iterable[str], order: Iterable[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; of rows that are equal in both, one. Nulls in the key count as equal."""
    key, order = list(key), list(order)
    value = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    won = rows.groupBy(*key).agg((F.max if last else F.min)(value).alias("_won")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "_won")
    hit = rows.join(won, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)] + [value.eqNullSafe(F.col("_won"))]).select(*rows.columns)
    one = F.row_number().over(W.partitionBy(*key).orderBy(*key))
    return hit.withColumn("_n", one).filter("_n = 1").drop("_n")
