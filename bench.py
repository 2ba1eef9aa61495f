"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose tables and cores. Each query runs whole, into a sink that drops its rows;
the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailspan.catalog import QUERIES  # noqa: E402
from trailspan.session import local_session  # noqa: E402

HEADLINE = [
    "track_length", "track_cumdist", "resample_track", "categorize", "corridor_join", "corridor_pois", "distance_sweep",
    "cache_upsert", "snippet_dedup", "snippet_topk", "hours_table", "price_level", "mappage_extract", "page_preview",
    "deterministic_enrich", "compact_desc", "job_latest", "engine_health", "ttl_misses",
]


def index_gain(spark, folder: str) -> dict[str, float]:
    """Seconds for the distances of 2,000 places to a track of 12,000 points, by the corridor join and by comparing all."""
    from pyspark.sql import functions as F

    from trailspan import testbed
    from trailspan.functions import geo
    from trailspan.operators import corridor, pois, tracks

    track = testbed.points(spark, folder).where("track_idx = 0 and seq < 12000")
    near = tracks.track_bbox(track).first()
    places = pois.categorize(testbed.elements(spark, folder)).select("poi_id", "lat", "lon")
    places = places.withColumn("lat", F.lit(near.min_lat) + F.abs(F.hash("poi_id")) % 1000 / 1000.0 * (near.max_lat - near.min_lat)).orderBy("poi_id").limit(2000)
    segments = tracks.measured_segments(track)
    ends = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    every = places.crossJoin(F.broadcast(segments)).withColumn("d", geo.segment_distance(F.col("lat"), F.col("lon"), *ends))  # a measure to beat, no query
    plans = {
        "join": corridor.track_distances(places, track, 1500.0),
        "all": every.groupBy("poi_id").agg(F.min("d").alias("d")).filter("d <= 1500"),
    }
    spent = {}
    for name, df in plans.items():
        df.write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    return spent | {"gain": round(spent["all"] / spent["join"], 2)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "12g")
    spark.sparkContext.setLogLevel("ERROR")
    spent: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        spent[name] = round(min(runs), 3)
        print(f"{name}: {spent[name]} (first {runs[0]:.2f})", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "index_gain": index_gain(spark, folder),
    }))


if __name__ == "__main__":
    main()
