"""Track operators: lengths, elevation, resampling, chunks.

A track table has one row per point, in the order of ``seq`` within a
``track_id``; gaps in ``seq`` change nothing. A single track may hold a large part of all points, so no window
runs over a whole track. Points are cut into blocks of ``seq``; windows run per
(track, block) and only one row per block takes part in track-wide windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import haversine
from ..functions.text import js_round

BLOCK = 1 << 13
_POINT = ["lat", "lon", "ele"]


def dense_seq(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Renumber ``seq`` to 0..n-1 per track, for tables with gaps."""
    pts = points.withColumn("_block", F.floor(F.col("seq") / block))
    before = W.partitionBy("track_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        pts.groupBy("track_id", "_block").agg(F.count("*").alias("_n"))
        .select("track_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("track_id", "_block").orderBy("seq")
    return (
        pts.withColumn("_pos", F.row_number().over(inside))
        .join(starts, ["track_id", "_block"])
        .withColumn("seq", F.col("_start") + F.col("_pos") - 1)
        .drop("_block", "_pos", "_start")
    )


def _segments_in_blocks(points: DataFrame, block: int) -> DataFrame:
    """Segment per point, blocked. The last point of a track becomes a tail row.

    Points pair up within their block; the last one of a block pairs with the first one of the track's next
    block that has any, so that gaps in ``seq`` change nothing. Only one row per block takes part in that.
    ``is_head`` marks the first point of a track.
    """
    key = ["track_id", "track_idx", "block"]
    # Named before the windows, so that no column is shuffled under two names.
    pts = points.select(
        "track_id", "track_idx", F.floor(F.col("seq") / block).alias("block"), F.col("seq").alias("seg_idx"), *[F.col(c).alias(f"a_{c}") for c in _POINT],
    )
    # The join below drops points without a key; asked for here, both its sides read the same.
    for c in key:
        pts = pts.filter(F.col(c).isNotNull())
    w = W.partitionBy(*key).orderBy("seg_idx")
    rows = pts.select(
        "*", *[F.lead(f"a_{c}").over(w).alias(f"b_{c}") for c in _POINT],
        F.lead("seg_idx").over(w).isNull().alias("_ends"), F.lag("seg_idx").over(w).isNull().alias("_starts"),
    )
    along = W.partitionBy("track_id", "track_idx").orderBy("block")
    # Column by column: what a query leaves out is read on neither side, so that both read one shuffle of the points.
    edges = rows.filter("_starts").select(
        *key, *[F.lead(f"a_{c}").over(along).alias(f"_next_{c}") for c in _POINT],
        F.lead("block").over(along).isNotNull().alias("_more"), F.lag("block").over(along).isNull().alias("_head"),
    )
    beyond = F.col("_ends") & F.col("_more")
    paired = rows.join(edges, key).withColumn("is_tail", F.col("_ends") & ~F.col("_more")).withColumn("is_head", F.col("_starts") & F.col("_head"))
    for c in _POINT:
        paired = paired.withColumn(f"b_{c}", F.when(beyond, F.col(f"_next_{c}")).otherwise(F.col(f"b_{c}")))
    return (
        paired.drop("_ends", "_starts", "_more", "_head", *[f"_next_{c}" for c in _POINT])
        .withColumn("b_lat", F.coalesce("b_lat", "a_lat"))
        .withColumn("b_lon", F.coalesce("b_lon", "a_lon"))
        .withColumn(
            "seg_len_m",
            F.when(F.col("is_tail"), F.lit(0.0)).otherwise(
                haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
            ),
        )
    )


def track_segments(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per pair of consecutive points, with its length."""
    return _segments_in_blocks(points, block).filter(~F.col("is_tail")).drop("is_tail", "is_head", "block")


def measured_segments(points: DataFrame, block: int = BLOCK, tail: bool = False) -> DataFrame:
    """Segments with ``cum_start_m``, ``cum_end_m`` and the track's ``total_m``.

    With ``tail`` the last point of each track is kept as a zero-length row, and so are ``is_tail``, ``is_head`` and ``block``.
    """
    running = W.partitionBy("track_id", "track_idx", "block").orderBy("seg_idx")
    within = _segments_in_blocks(points, block).withColumn(
        "_end", F.sum("seg_len_m").over(running.rowsBetween(W.unboundedPreceding, 0))
    )
    # Lengths are never negative, so the largest running sum is the block's sum,
    # and taking it from there keeps both sides equal to the last bit.
    # The track index takes part in the join so that both sides need the same
    # columns and share one shuffle.
    key = ["track_id", "track_idx", "block"]
    by_block = W.partitionBy("track_id").orderBy("block")
    blocks = within.groupBy(*key).agg(F.max("_end").alias("_len"), F.count("*").alias("_n"))
    blocks = blocks.select(
        *key, "_n",
        F.sum("_len").over(by_block.rowsBetween(W.unboundedPreceding, 0)).alias("_through"),
    )
    blocks = blocks.select(
        *key,
        F.coalesce(F.lag("_through").over(by_block), F.lit(0.0)).alias("_offset"),
        F.max("_through").over(W.partitionBy("track_id")).alias("total_m"),
        F.sum("_n").over(W.partitionBy("track_id")).alias("n_points"),
    )
    out = (
        within.join(blocks, key)
        .withColumn("cum_end_m", F.col("_offset") + F.col("_end"))
        .withColumn("_start", F.lag("_end").over(running))
        .withColumn("cum_start_m", F.col("_offset") + F.coalesce("_start", F.lit(0.0)))
        .drop("_offset", "_end", "_start")
    )
    return out if tail else out.filter(~F.col("is_tail")).drop("is_tail", "is_head", "block")


def cumulative_distance(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distance from the start of the track at every point."""
    return measured_segments(points, block, tail=True).select(
        "track_id", "track_idx", F.col("seg_idx").alias("seq"),
        F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"),
        F.col("cum_start_m").alias("cum_m"),
    )


def track_length(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Path length and point count per track."""
    return (
        _segments_in_blocks(points, block).groupBy("track_id", "track_idx")
        .agg(F.sum("seg_len_m").alias("total_distance_m"), F.count("*").alias("n_points"))
    )


def elevation_stats(
    points: DataFrame, noise_m: float = 2.0, strict: bool = True, block: int = BLOCK
) -> DataFrame:
    """Climb and descent per track, ignoring steps below the noise floor.

    ``strict``: one missing elevation zeroes the whole track. Otherwise the steps
    next to a gap are skipped. NaN steps never count.
    """
    segments = _segments_in_blocks(points, block)
    step = F.col("b_ele") - F.col("a_ele")
    real = ~F.col("is_tail") & step.isNotNull() & ~F.isnan(step)
    gain = F.sum(F.when(real & (step >= noise_m), step))
    loss = F.sum(F.when(real & (step <= -noise_m), -step))
    # A track of one point has no step, so its elevation does not matter.
    gap = F.coalesce(
        F.bool_or(~F.col("is_tail") & (F.col("a_ele").isNull() | F.col("b_ele").isNull())), F.lit(False)
    )
    keep = (lambda c: F.when(gap, F.lit(0)).otherwise(c)) if strict else (lambda c: c)
    return segments.groupBy("track_id", "track_idx").agg(
        keep(js_round(F.coalesce(gain, F.lit(0.0)))).alias("elevation_gain_m"),
        keep(js_round(F.coalesce(loss, F.lit(0.0)))).alias("elevation_loss_m"),
    )


def track_table(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Track dimension: length, climb, descent and number of points in one pass."""
    segments = _segments_in_blocks(points, block)
    step = F.col("b_ele") - F.col("a_ele")
    real = ~F.col("is_tail") & step.isNotNull() & ~F.isnan(step)
    gap = F.bool_or(~F.col("is_tail") & (F.col("a_ele").isNull() | F.col("b_ele").isNull()))
    zero = lambda c: F.when(gap, F.lit(0)).otherwise(js_round(F.coalesce(c, F.lit(0.0))))
    return segments.groupBy("track_id", "track_idx").agg(
        F.sum("seg_len_m").alias("total_distance_m"),
        zero(F.sum(F.when(real & (step >= 2), step))).alias("elevation_gain_m"),
        zero(F.sum(F.when(real & (step <= -2), -step))).alias("elevation_loss_m"),
        F.count("*").alias("n_points"),
    )


def resample(points: DataFrame, spacing_m: float = 500.0, block: int = BLOCK) -> DataFrame:
    """Evenly spaced points along each track.

    Each segment produces the target positions that fall into it, so no range
    join is needed and a long track is resampled by many tasks.
    """
    seg = measured_segments(points, block, tail=True)
    wanted = F.greatest(F.lit(2), js_round(F.col("total_m") / F.lit(float(spacing_m))))
    single = (F.col("n_points") < 2) | (F.col("total_m") == 0)
    last = F.col("_wanted") - 1
    # Candidates around the segment's share of the targets; the exact test is below.
    low = F.greatest(F.lit(0), F.floor(F.col("cum_start_m") / F.col("total_m") * last) - 1)
    high = F.least(last, F.ceil(F.col("cum_end_m") / F.col("total_m") * last) + 1)
    target = F.col("idx") / last * F.col("total_m")
    first_segment = F.col("is_head") & (F.col("idx") == 0)
    inside = (target > F.col("cum_start_m")) & (target <= F.col("cum_end_m"))

    def between(column: str) -> Column:
        return F.col(f"a_{column}") + F.col("t") * (F.col(f"b_{column}") - F.col(f"a_{column}"))

    many = (
        seg.filter(~single & ~F.col("is_tail"))
        .withColumn("_wanted", wanted)
        .withColumn("idx", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
        .filter(first_segment | inside)
        .withColumn(
            "t",
            F.when(F.col("seg_len_m") > 0, (target - F.col("cum_start_m")) / (F.col("cum_end_m") - F.col("cum_start_m")))
            .otherwise(F.lit(0.0)),
        )
        .select(
            "track_id", "track_idx", F.col("idx").alias("seq"), between("lat").alias("lat"),
            between("lon").alias("lon"),
            F.when(F.col("a_ele").isNotNull() & F.col("b_ele").isNotNull(), between("ele"))
            .otherwise(F.col("a_ele")).alias("ele"),
        )
    )
    # A single point, or a track that never moves, keeps its first point only.
    one = seg.filter(single & F.col("is_head")).select(
        "track_id", "track_idx", F.lit(0).cast("long").alias("seq"),
        F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("a_ele").alias("ele"),
    )
    return many.unionByName(one)


def track_bbox(points: DataFrame, *keys: str) -> DataFrame:
    """Bounding box of all points, or one per key."""
    return points.groupBy(*keys).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


def track_rollup(points: DataFrame, spacing_m: float = 500.0, block: int = BLOCK) -> DataFrame:
    """Points, resampled points and length per track, and the same over all tracks.

    How many points resampling yields follows from the length alone, so nothing
    is resampled to count them.
    """
    per_track = track_length(points, block)
    still = (F.col("n_points") < 2) | (F.col("total_distance_m") == 0)
    resampled = F.when(still, F.lit(1)).otherwise(
        F.greatest(F.lit(2), js_round(F.col("total_distance_m") / F.lit(float(spacing_m))))
    )
    return (
        per_track.withColumn("n_resampled", resampled).rollup("track_id")
        .agg(
            F.sum("n_points").alias("n_points"), F.sum("n_resampled").alias("n_resampled"),
            F.sum("total_distance_m").alias("total_distance_m"),
        )
    )


def chunk_points(points: DataFrame, max_points: int = 25, overlap: int = 3) -> DataFrame:
    """Each point with every chunk it belongs to (one or two of them)."""
    step = max_points - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - (max_points - 1)) / step))
    last = F.floor(F.col("seq") / step)
    return points.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def track_chunks(points: DataFrame, max_points: int = 25, overlap: int = 3) -> DataFrame:
    """Overlapping windows of consecutive points, one row per kept chunk.

    A chunk needs two points; a track that fits into one chunk has only that one.
    """
    return (
        chunk_points(points, max_points, overlap)
        .groupBy("track_id", "track_idx", "chunk")
        .agg(F.count("*").alias("n_points"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .filter(
            (F.col("chunk") == 0)
            | ((F.col("n_points") >= 2) & (F.col("last_seq") >= max_points))
        )
    )
