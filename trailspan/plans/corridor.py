"""Tracks and map elements in, places in travel order out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corridor, dedup, pois


def corridor_pois(
    elements: DataFrame,
    points: DataFrame,
    max_distance_m: float = 1500.0,
    dedup_radius_m: float = 50.0,
    categories: Iterable[str] | None = None,
) -> DataFrame:
    """Categorise, keep what is near a track, merge duplicates, order by position.

    ``elements`` needs ``ord``, the input order, unique per element. If ``points`` has ``run_id``
    (one user's upload), every run is worked on by itself: what is near, the merging radius, the
    merging and the order depend on its own tracks alone.
    """
    places = pois.categorize(elements, categories)
    near = corridor.corridor_filter(places, points, max_distance_m)
    kept = dedup.dedup_pois(near, dedup_radius_m)
    run = [F.col("run_id")] if "run_id" in kept.columns else []
    return kept.orderBy(*run, F.col("along_trace_distance"), F.col("ord"))


def sweep(
    places: DataFrame, points: DataFrame, thresholds: Iterable[float], dedup_radius_m: float = 50.0
) -> DataFrame:
    """Kept places for each limit, as a whole run with that limit would keep them; per run if the points have runs.

    Distances are computed once, for the largest limit. Every (run, limit) is merged by itself, with the radius that its own number
    of places asks for, but all of them together: one graph, one series of rounds.
    """
    limits = sorted(float(t) for t in thresholds)
    near = corridor.within_limits(corridor.track_distances(places, points, limits[-1]), limits)
    run = F.col("run_id") if "run_id" in near.columns else F.lit("run")
    each = places.drop("run_id").join(near.withColumn("_run", run).drop("run_id"), "poi_id").withColumn(
        "run_id", F.to_json(F.struct("_run", "max_distance_m")))
    kept = dedup.dedup_pois(each, dedup_radius_m)
    key = ["_run", "max_distance_m"]
    out = kept.groupBy(*key).agg(
        F.count("*").alias("n_pois"), F.sum("n_merged").alias("n_near"), F.sum("distance_to_trace").alias("sum_distance_m"))
    return out.withColumnRenamed("_run", "run_id") if "run_id" in near.columns else out.drop("_run")
