"""The corridor join: which places lie near which track, and where along it.

Up to ``RUN`` consecutive segments of a track are one row, a run, with the box around them, padded by the
search distance. Runs are laid out over the cells of a degree grid; a place has exactly one cell. An equi-join on
the cell therefore finds every pair of place and run whose box holds it, once, and never plans a nested loop. Only runs
that pass are opened into segments, and only segments whose own box holds the place are measured. Pairs are
reduced to one row per (place, track) on the map side, before any shuffle, so a
crowded cell costs computing but no data movement; adaptive execution splits the
join of such a cell over several tasks.

Exact within latitudes of 85 degrees and for tracks that do not cross the
antimeridian.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .tracks import BLOCK, measured_segments

CELL_DEG = 0.08
#: Segments of a run at most.
RUN = 16


def cell_size(max_distance_m: float) -> float:
    """Grid step: at least the search distance, so a segment fills few cells."""
    return max(CELL_DEG, max_distance_m / geo.METRES_PER_DEGREE)


def _segment_cells(max_distance_m: float, size: float) -> Column:
    """Cells in which a segment may have neighbours.

    A long segment is laid out piece by piece, so its cell count grows with its
    length and not with the area of its box.
    """
    d_lat, d_lon = F.col("b_lat") - F.col("a_lat"), F.col("b_lon") - F.col("a_lon")
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(d_lat), F.abs(d_lon)) / F.lit(size))).cast("int")
    pad_lat = geo.lat_margin(max_distance_m)
    pad_lon = geo.lon_margin(max_distance_m, F.greatest(F.abs("a_lat"), F.abs("b_lat")))

    def box_cells(share_from: Column, share_to: Column) -> Column:
        lat0, lat1 = F.col("a_lat") + share_from * d_lat, F.col("a_lat") + share_to * d_lat
        lon0, lon1 = F.col("a_lon") + share_from * d_lon, F.col("a_lon") + share_to * d_lon
        return geo.cells_in_box(
            F.least(lat0, lat1) - pad_lat, F.greatest(lat0, lat1) + pad_lat,
            F.least(lon0, lon1) - pad_lon, F.greatest(lon0, lon1) + pad_lon, size,
        )

    by_piece = F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: box_cells(i / pieces, (i + 1) / pieces)))
    return F.when(pieces == 1, box_cells(F.lit(0.0), F.lit(1.0))).otherwise(F.array_distinct(by_piece))


def segment_runs(segments: DataFrame, max_distance_m: float, run: int = RUN, cell_deg: float | None = None) -> DataFrame:
    """One row per track, run of consecutive segments and cell: ``cell``, the run's padded box, and its segments.

    Segments that are cut into blocks are grouped within their block, which needs no shuffle.
    """
    key = [c for c in ("track_id", "track_idx", "block") if c in segments.columns]
    held = [c for c in segments.columns if c not in key]
    pad_lat = geo.lat_margin(max_distance_m)
    far = F.max(F.greatest(F.abs("a_lat"), F.abs("b_lat")))
    runs = (
        segments.withColumn("_cells", _segment_cells(max_distance_m, cell_deg or cell_size(max_distance_m)))
        .groupBy(*key, F.floor(F.col("seg_idx") / run).alias("_run")).agg(
            F.collect_list(F.struct(*held)).alias("segments"), F.array_distinct(F.flatten(F.collect_list("_cells"))).alias("_cells"),
            (F.min(F.least("a_lat", "b_lat")) - pad_lat).alias("min_lat"), (F.max(F.greatest("a_lat", "b_lat")) + pad_lat).alias("max_lat"),
            F.min(F.least("a_lon", "b_lon")).alias("min_lon"), F.max(F.greatest("a_lon", "b_lon")).alias("max_lon"), far.alias("_far"),
        )
    )
    pad_lon = geo.lon_margin(max_distance_m, F.col("_far"))
    return (
        runs.withColumn("min_lon", F.col("min_lon") - pad_lon).withColumn("max_lon", F.col("max_lon") + pad_lon)
        .withColumn("cell", F.explode("_cells")).drop("_cells", "_run", "_far", "block")
    )


def _in_box(max_distance_m: float) -> Column:
    """The place lies in the segment's padded box."""
    pad_lat = geo.lat_margin(max_distance_m)
    pad_lon = geo.lon_margin(max_distance_m, F.greatest(F.abs("a_lat"), F.abs("b_lat")))
    lat, lon = F.col("lat"), F.col("lon")
    return (
        (lat >= F.least("a_lat", "b_lat") - pad_lat) & (lat <= F.greatest("a_lat", "b_lat") + pad_lat)
        & (lon >= F.least("a_lon", "b_lon") - pad_lon) & (lon <= F.greatest("a_lon", "b_lon") + pad_lon)
    )


def near_runs(places: DataFrame, segments: DataFrame, max_distance_m: float, run: int = RUN) -> DataFrame:
    """Places with the runs whose padded box holds them: a test of four comparisons."""
    located = places.withColumn("cell", geo.cell_of(F.col("lat"), F.col("lon"), cell_size(max_distance_m)))
    return (
        located.join(segment_runs(segments, max_distance_m, run), "cell")
        .filter("lat between min_lat and max_lat and lon between min_lon and max_lon")
        .drop("cell", "min_lat", "max_lat", "min_lon", "max_lon")
    )


def near_segments(places: DataFrame, segments: DataFrame, max_distance_m: float, run: int = RUN) -> DataFrame:
    """Places with the segments whose padded box holds them.

    Adds ``t``, the share along the segment, and ``d``, the distance. No pair
    within the distance is missing; pairs beyond it are not all dropped.
    """
    ends = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    runs = near_runs(places, segments, max_distance_m, run)
    return (
        runs.select(*[c for c in runs.columns if c != "segments"], F.inline("segments"))
        .filter(_in_box(max_distance_m))
        .withColumn("t", geo.segment_fraction(F.col("lat"), F.col("lon"), *ends))
        .withColumn("d", geo.distance_at_fraction(F.col("lat"), F.col("lon"), *ends, F.col("t")))
    )


def track_distances(
    pois: DataFrame, points: DataFrame, max_distance_m: float = 1500.0, block: int = BLOCK
) -> DataFrame:
    """Distance and position along the track for each (place, track) in reach.

    Columns: ``poi_id``, ``track_idx``, ``track_id``, ``distance_m``, ``along_m``, and ``run_id`` (one user's
    upload) if the points have it.
    The distance is the least over all segments and the last point; the position
    belongs to the nearest segment, the first one on a tie.
    """
    segments = measured_segments(points, block, tail=True).select(
        "track_idx", "track_id", "block", "seg_idx", "a_lat", "a_lon", "b_lat", "b_lon", "seg_len_m", "cum_start_m", "is_tail"
    )
    # Every place whose only close part is the last point still meets the segment
    # that ends there, because boxes and not distances decide.
    pairs = near_segments(pois.select("poi_id", "lat", "lon"), segments, max_distance_m)
    on_segment = F.when(
        ~F.col("is_tail"), F.struct("d", "seg_idx", (F.col("cum_start_m") + F.col("t") * F.col("seg_len_m")).alias("at"))
    )
    near = (
        pairs.groupBy("poi_id", "track_idx", "track_id")
        .agg(F.min("d").alias("distance_m"), F.min(on_segment).alias("_best"))
        .filter(F.col("distance_m") <= float(max_distance_m))
        .select(
            "poi_id", "track_idx", "track_id", "distance_m",
            F.coalesce("_best.at", F.lit(0.0)).alias("along_m"),
        )
    )
    if "run_id" not in points.columns:
        return near
    # A track belongs to one run: one row per track is joined.
    return near.join(points.groupBy("track_idx", "track_id").agg(F.min("run_id").alias("run_id")), ["track_idx", "track_id"])


def nearest_track(distances: DataFrame) -> DataFrame:
    """The nearest track of each place, in each run if there are runs; the lowest track index wins a tie."""
    best = F.min(F.struct("distance_m", "track_idx", "track_id", "along_m")).alias("_best")
    key = [c for c in ("run_id", "poi_id") if c in distances.columns]
    return distances.groupBy(*key).agg(best).select(
        *key, F.col("_best.track_idx").alias("track_idx"), F.col("_best.track_id").alias("track_id"),
        F.col("_best.distance_m").alias("distance_to_trace"),
        F.col("_best.along_m").alias("along_trace_distance"),
    )


def corridor_filter(
    pois: DataFrame, points: DataFrame, max_distance_m: float = 1500.0, block: int = BLOCK
) -> DataFrame:
    """Places within the distance of any track, with distance and position; once for each run the points name.

    The join works on ids and coordinates only; the other columns are fetched for
    the places that are kept.
    """
    near = nearest_track(track_distances(pois, points, max_distance_m, block))
    return pois.drop("run_id").join(near, "poi_id") if "run_id" in near.columns else pois.join(near, "poi_id")


def within_limits(distances: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """The nearest track of each place (in each run), once for every limit it satisfies, as ``max_distance_m``.

    Distances are computed once, for the largest limit; nothing is joined again.
    """
    limits = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    reached = F.filter(limits, lambda t: t >= F.col("distance_to_trace"))
    return nearest_track(distances).withColumn("max_distance_m", F.explode(reached))


def distance_sweep(distances: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """Places per distance limit, and per run if there are runs, before merging."""
    near = within_limits(distances, thresholds)
    key = [c for c in ("run_id", "max_distance_m") if c in near.columns]
    return near.groupBy(*key).agg(F.count("*").alias("n_pois"), F.sum("distance_to_trace").alias("sum_distance_m"))
