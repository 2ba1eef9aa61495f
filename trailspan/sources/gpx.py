"""GPX files to track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import GPX


def _number(raw: Column) -> Column:
    """Leading number of a text, as lenient parsers read it; null without one."""
    return T.first_match(raw, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def parse_gpx(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Points and rejects of GPX texts, one row per file in.

    Track points of all tracks and segments are chained in document order; route
    points count only where there are none. Points without a usable coordinate are
    dropped before numbering, so ``seq`` is dense. A file that is not XML or holds no
    point is a reject.
    """
    raw = F.col(content).cast("string")
    # A prefix on the root element is on all elements: they are read without it.
    plain = F.when(raw.rlike(r"<[A-Za-z_][\w.\-]*:gpx[\s>]"), F.regexp_replace(raw, r"<(/?)[A-Za-z_][\w.\-]*:", "<$1")).otherwise(raw)
    doc = files.withColumn("_gpx", F.from_xml(plain, GPX))

    def joined(parts: Column) -> Column:
        """All members in order; a part that is missing or empty has none."""
        return F.flatten(F.filter(parts, lambda p: p.isNotNull()))

    segments = F.transform("_gpx.trk", lambda t: joined(F.transform(t["trkseg"], lambda s: s["trkpt"])))
    track_points, route_points = joined(segments), joined(F.transform("_gpx.rte", lambda r: r["rtept"]))

    def usable(points: Column) -> Column:
        present = F.filter(points, lambda p: p.isNotNull())
        parsed = F.transform(
            present,
            lambda p: F.struct(
                _number(p["_lat"]).alias("lat"), _number(p["_lon"]).alias("lon"),
                # An element that holds no number is NaN, a missing one is null.
                F.when(p["ele"].isNotNull(), F.coalesce(_number(p["ele"]), F.lit(float("nan")))).alias("ele"),
                p["time"].alias("time"),
            ),
        )
        return F.filter(parsed, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())

    parsed = doc.select(
        F.col(path).alias("path"), F.col("_gpx"), usable(track_points).alias("_trk"), usable(route_points).alias("_rte")
    )
    file_name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.gpx$", "")
    named = parsed.select(
        "path",
        F.coalesce(
            F.col("_gpx.metadata.name"),
            F.get(F.filter(F.transform("_gpx.trk", lambda t: t["name"]), lambda n: n.isNotNull()), F.lit(0)),
            file_name,
        ).alias("name"),
        F.when(F.size("_trk") > 0, F.col("_trk")).otherwise(F.col("_rte")).alias("_points"),
        F.col("_gpx._corrupt_record").isNotNull().alias("_bad"),
    )
    good = ~F.col("_bad") & (F.coalesce(F.size("_points"), F.lit(-1)) > 0)
    points = named.filter(good).select("path", "name", F.posexplode("_points").alias("seq", "p")).select(
        F.col("path").alias("track_id"), "name", F.col("seq").cast("long").alias("seq"), "p.*"
    )
    rejects = named.filter(~good).select(
        "path",
        F.when(F.col("_bad"), "Invalid GPX file: XML parse error")
        .otherwise("No track or route points found in GPX file").alias("error"),
    )
    return points, rejects


def read_gpx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and rejects of every ``.gpx`` file below ``path``."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[gG][pP][xX]")
        .option("recursiveFileLookup", "true").load(path)
    )
    return parse_gpx(files)
