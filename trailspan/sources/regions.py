"""Map elements stored by cell, and the part of them that lies around the lines.

``write_elements`` lays a table of elements out in folders, one for each cell of a degree grid.
``around`` reads only the folders of cells that the tracks' padded segments touch: the join on the partition column
prunes them at run time. The cover is a superset of what is within the radius; ``operators.corridor`` measures exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.corridor import segment_runs
from ..operators.tracks import BLOCK, measured_segments
from ..scratch import written

# Fixed value: how far around the line a source is asked, in metres.
SOURCE_RADIUS_M = 1000.0
#: Folder size in degrees: some 80 km, so a region has few folders and a planet some 100,000.
REGION_DEG = 0.5


def _place() -> tuple[Column, Column]:
    """Coordinate of an element: a node's own, its centre otherwise."""
    node = F.col("type") == "node"
    return F.when(node, F.col("lat")).otherwise(F.col("center.lat")), F.when(node, F.col("lon")).otherwise(F.col("center.lon"))


def write_elements(elements: DataFrame, path: str, region_deg: float = REGION_DEG) -> None:
    """Elements that have a place, in folders by region. Rows are dealt by region and a hash of their id, so that a full one is split."""
    lat, lon = _place()
    placed = elements.withColumn("region", geo.cell_of(lat, lon, region_deg)).filter("region is not null")
    spread = F.pmod(F.xxhash64("type", "id"), F.lit(8))
    placed.repartition("region", spread).write.partitionBy("region").parquet(path)


def regions_around(points: DataFrame, radius_m: float = SOURCE_RADIUS_M, region_deg: float = REGION_DEG, block: int = BLOCK) -> DataFrame:
    """Distinct regions that the tracks' padded segments touch, as a written table: a row for each folder, never more."""
    segments = measured_segments(points, block, tail=True).select("track_idx", "track_id", "block", "seg_idx", "a_lat", "a_lon", "b_lat", "b_lon")
    return written(segment_runs(segments, radius_m, cell_deg=region_deg).select(F.col("cell").alias("region")).distinct(), "regions")


def around(
    spark: SparkSession, path: str, schema: str, points: DataFrame, radius_m: float = SOURCE_RADIUS_M, region_deg: float = REGION_DEG
) -> DataFrame:
    """Elements of the regions around the lines. ``schema`` is that of the written elements, without ``region``."""
    stored = spark.read.schema(f"{schema}, region long").parquet(path)
    # The bound is that of the grid itself; with it Spark takes the join for selective and prunes by it.
    wanted = regions_around(points, radius_m, region_deg).filter(F.col("region") > F.lit(-(1 << 62)))
    return stored.join(wanted, "region", "left_semi").drop("region")
