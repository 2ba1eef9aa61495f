"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (x, y: long): the smallest node that links lead to.

    A round gives each node the smallest label around it and then that label's own label, so the
    distance that is covered doubles. Labels go through minima that Spark combines before it
    shuffles; each round is a written table. Raises if ``MOST_ROUNDS`` don't settle it.
    """
    both = written(links.select("x", "y").unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both["x"] == labels["node"]).groupBy(F.col("y").alias("node")).agg(F.min("label").alias("near"))
        hooked = written(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old != label").limit(1).count():
            return labels
    raise RuntimeError("components didn't settle")
