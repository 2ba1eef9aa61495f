"""GeoJSON features, GPX and KML documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators.pois import osmand_icon
from .describe import compact_description, html_description, is_done

# The enrichment columns an export may use, with their types.
ENRICHMENT = (
    "struct<status:string,rating:double,review_count:bigint,hours:string,"
    "opening_hours:array<struct<day:string,open:string,close:string>>,description:string,review:string,"
    "summary:string,translated_summary:string,essentials:string,specialty:string,price_level:int,"
    "google_maps_url:string,locality:string,source_count:int,source_engines:array<string>,confidence:double,"
    "synthesis_source:string,synthesis_reason:string,google_maps_fields:array<string>,"
    "structured:struct<headline:string,operational_summary:string,practicalities:array<string>,"
    "source_rollup:array<struct<platform:string,brief:string,url:string>>,cautions:array<string>,"
    "unknowns:array<string>,divergences:array<string>,source_confirmation:string>>"
)


def with_enrichment(pois: DataFrame, enriched: DataFrame | None) -> DataFrame:
    """Places with their enrichment as struct ``e``; null where there is none."""
    if enriched is None:
        return pois.withColumn("e", F.lit(None).cast(ENRICHMENT))
    have = set(enriched.columns)
    struct = F.struct(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields()
    ])
    return pois.join(enriched.select("poi_id", struct.alias("e")), "poi_id", "left")


def _fields():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"e {ENRICHMENT}")["e"].dataType.fields


def _json(value: Column, kind: str = "string") -> Column:
    """A map value; null becomes the JSON null, as an object in memory would show it."""
    return F.coalesce(value.cast(kind).cast("variant"), F.parse_json(F.lit("null")))


def geojson_features(pois: DataFrame) -> DataFrame:
    """One GeoJSON feature per place as text.

    Tags come after the fixed properties and may overwrite them; enrichment
    properties are added for finished places only. Needs ``e``.
    """
    e = F.col("e")
    s = e["structured"]

    def joined(values: Column, by: str) -> Column:
        return _json(F.when(values.isNotNull(), F.array_join(values, by)))

    hours = F.transform(e["opening_hours"], lambda h: F.concat(
        h["day"], F.lit(": "),
        F.when(h["open"] == "closed", F.lit("Closed")).otherwise(F.concat(h["open"], F.lit("-"), F.coalesce(h["close"], F.lit("")))),
    ))
    rollup = F.transform(s["source_rollup"], lambda d: F.concat(d["platform"], F.lit(": "), d["brief"]))
    extra = {
        "rating": _json(e["rating"], "double"), "reviewCount": _json(e["review_count"], "bigint"), "hours": _json(e["hours"]),
        "openingHours": joined(hours, "; "), "description": _json(e["description"]), "review": _json(e["review"]),
        "summary": _json(e["summary"]), "translatedSummary": _json(e["translated_summary"]),
        "essentials": _json(e["essentials"]), "specialty": _json(e["specialty"]), "priceLevel": _json(e["price_level"], "int"),
        "googleMapsUrl": _json(e["google_maps_url"]), "locality": _json(e["locality"]),
        "sourceCount": _json(e["source_count"], "int"), "sourceEngines": joined(e["source_engines"], ","),
        "confidence": _json(e["confidence"], "double"), "synthesisSource": _json(e["synthesis_source"]),
        "synthesisReason": _json(e["synthesis_reason"]), "googleMapsFields": joined(e["google_maps_fields"], ","),
        "structured_headline": _json(s["headline"]), "structured_operationalSummary": _json(s["operational_summary"]),
        "structured_practicalities": joined(s["practicalities"], " | "), "structured_cautions": joined(s["cautions"], " | "),
        "structured_unknowns": joined(s["unknowns"], " | "), "structured_sourceRollup": joined(rollup, " | "),
        "structured_divergences": joined(s["divergences"], " | "),
        "structured_sourceConfirmation": _json(s["source_confirmation"]),
    }
    fixed = F.create_map(
        F.lit("name"), _json(F.col("name")), F.lit("category"), _json(F.col("category")), F.lit("icon"), _json(F.col("icon")),
        F.lit("distanceToTrace"), _json(T.js_round(F.col("distance_to_trace")), "bigint"),
    )
    tags = F.transform_values("tags", lambda _k, v: v.cast("variant"))
    added = F.create_map(*[x for name, value in extra.items() for x in (F.lit(f"enrichment_{name}"), value)])
    properties = F.when(is_done(), F.map_concat(fixed, tags, added)).otherwise(F.map_concat(fixed, tags))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    )
    return pois.select("poi_id", F.to_json(feature).alias("feature"))


def waypoints(pois: DataFrame, osmand: bool = False) -> DataFrame:
    """Adds ``text``, the ``<wpt>`` element of each place. Needs ``e``."""
    symbol = F.coalesce(T.lookup(rules.GPX_SYMBOL, F.col("category")), F.lit(rules.GPX_SYMBOL_FALLBACK))
    parts = [
        F.lit('  <wpt lat="'), T.number_text(F.col("lat")), F.lit('" lon="'), T.number_text(F.col("lon")), F.lit('">\n    <name>'),
        T.escape_xml(F.col("name")), F.lit("</name>\n    <desc>"), T.escape_xml(compact_description()),
        F.lit("</desc>\n    <type>"), T.escape_xml(F.col("category")), F.lit("</type>\n    <sym>"), symbol, F.lit("</sym>\n"),
    ]
    if osmand:
        parts += [
            F.lit("    <extensions>\n      <osmand:icon>"), osmand_icon("tags", F.col("category")),
            F.lit("</osmand:icon>\n      <osmand:color>"), _colour(), F.lit("</osmand:color>\n      <osmand:background>"),
            _background(), F.lit("</osmand:background>\n    </extensions>\n"),
        ]
    return pois.withColumn("text", F.concat(*parts, F.lit("  </wpt>")))


def _colour() -> Column:
    return F.coalesce(T.lookup(rules.BACKGROUND_COLOUR, F.col("category")), F.lit(rules.OSMAND_COLOUR_FALLBACK))


def _background() -> Column:
    return F.coalesce(T.lookup(rules.OSMAND_BACKGROUND, F.col("category")), F.lit(rules.OSMAND_BACKGROUND_FALLBACK))


def _lines(df: DataFrame, section: int, order: Column, text: Column, tie: Column | None = None) -> DataFrame:
    """``tie`` decides between lines of equal ``ord``, so that equal input gives equal files."""
    return df.select(
        "doc_id", F.lit(section).alias("section"), order.cast("long").alias("ord"), (F.lit("") if tie is None else tie).alias("tie"), text.alias("text"),
    )


def gpx_lines(pois: DataFrame, points: DataFrame, tracks: DataFrame, osmand: bool = False) -> DataFrame:
    """GPX documents, one per ``track_id``, as text lines.

    ``tracks``: ``track_id, name``. Places come in travel order; the time stamp of
    a document is left out so that equal input gives equal files.
    """
    docs = tracks.select(F.col("track_id").alias("doc_id"), F.coalesce("name", F.lit("Route")).alias("name"))
    extra = '\n  xmlns:osmand="https://osmand.net"' if osmand else ""
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trailspan" '
        f'xmlns="http://www.topografix.com/GPX/1/1"{extra}>\n  <metadata>\n    <name>Places along the route</name>\n  </metadata>'
    )
    by_doc = pois.withColumn("doc_id", F.col("track_id"))
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("\n        <ele>"), T.number_text(F.col("ele")), F.lit("</ele>")))
    point = F.concat(
        F.lit('      <trkpt lat="'), T.number_text(F.col("lat")), F.lit('" lon="'), T.number_text(F.col("lon")), F.lit('">'),
        F.coalesce(ele, F.lit("")), F.lit("\n      </trkpt>"),
    )
    position = T.js_round(F.col("along_trace_distance") * 1000)
    parts = [
        _lines(docs, 0, F.lit(0), F.lit(head)),
        _lines(waypoints(by_doc, osmand), 4, position, F.col("text"), F.col("poi_id")),
        _lines(docs, 5, F.lit(0), F.concat(F.lit("  <trk>\n    <name>"), T.escape_xml(F.col("name")), F.lit("</name>\n    <trkseg>"))),
        _lines(points.withColumn("doc_id", F.col("track_id")), 6, F.col("seq"), point),
        _lines(docs, 7, F.lit(0), F.lit("    </trkseg>\n  </trk>\n</gpx>")),
    ]
    if osmand:
        # One row per (document, category), placed where the category is first met.
        used = by_doc.groupBy("doc_id", "category").agg(F.min(position).alias("first"))
        group = F.concat(
            F.lit('      <group name="'), T.escape_xml(F.col("category")), F.lit('" color="'), _colour(), F.lit('" icon="'),
            F.coalesce(T.lookup(rules.OSMAND_ICON, F.col("category")), F.lit(rules.OSMAND_ICON_FALLBACK)),
            F.lit('" background="'), _background(), F.lit('" />'),
        )
        parts += [
            _lines(docs, 1, F.lit(0), F.lit("  <extensions>\n    <osmand:points_groups>")),
            _lines(used, 2, F.col("first"), group, F.col("category")),
            _lines(docs, 3, F.lit(0), F.lit("    </osmand:points_groups>\n  </extensions>")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kml_colour(hex_colour: Column) -> Column:
    """``#rrggbb`` as ``bbggrr``; white when it is not six digits."""
    clean = F.replace(hex_colour, F.lit("#"), F.lit(""))
    return F.when(F.char_length(clean) != 6, F.lit("ffffff")).otherwise(
        F.concat(F.substring(clean, 5, 2), F.substring(clean, 3, 2), F.substring(clean, 1, 2))
    )


def placemarks(pois: DataFrame) -> DataFrame:
    """Adds ``text``, the KML placemark of each place. Needs ``e``."""
    return pois.withColumn("text", F.concat(
        F.lit("      <Placemark>\n        <name>"), T.escape_xml(F.col("name")),
        F.lit("</name>\n        <description><![CDATA["), html_description(),
        F.lit("]]></description>\n        <Style><IconStyle><color>ff"), kml_colour(_colour()),
        F.lit("</color><scale>1.0</scale></IconStyle></Style>\n        <Point><coordinates>"),
        T.number_text(F.col("lon")), F.lit(","), T.number_text(F.col("lat")), F.lit(",0</coordinates></Point>\n      </Placemark>"),
    ))


def kml_lines(pois: DataFrame, points: DataFrame, tracks: DataFrame) -> DataFrame:
    """KML documents, one per ``track_id``: the track, then a folder per category.

    Folders come in the order their first place is met. ``ord`` packs the folder's
    place in that order and the line's place in the folder by text, so only one
    row per (document, category) is looked up.
    """
    by_doc = pois.withColumn("doc_id", F.col("track_id")).withColumn("_at", T.js_round(F.col("along_trace_distance") * 1000))
    folders = by_doc.groupBy("doc_id", "category").agg(F.min("_at").alias("folder"))
    docs = tracks.select(
        F.col("track_id").alias("doc_id"), F.coalesce("name", F.lit("Route")).alias("name"),
        (F.col("color") if "color" in tracks.columns else F.lit("#1a1a1a")).alias("color"),
    )
    point = F.concat_ws(
        ",", T.number_text(F.col("lon")), T.number_text(F.col("lat")), F.coalesce(T.number_text(F.col("ele")), F.lit("0"))
    )

    def line(df: DataFrame, section: int, text: Column, folder: str | None = None, order: Column | None = None, tie: Column | None = None) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select(
            "doc_id", F.lit(section).alias("section"), (F.col(folder) if folder else zero).alias("folder"),
            (F.col("category") if folder else F.lit("")).alias("category"),
            (order if order is not None else zero).cast("long").alias("ord"),
            (F.lit("") if tie is None else tie).alias("tie"), text.alias("text"),
        )

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>Places along the route</name>'
    track_head = F.concat(
        F.lit("    <Placemark>\n      <name>"), T.escape_xml(F.col("name")), F.lit("</name>\n      <Style><LineStyle><color>ff"),
        kml_colour(F.col("color")), F.lit("</color><width>3</width></LineStyle></Style>\n      <LineString><tessellate>1</tessellate><coordinates>"),
    )
    parts = [
        line(docs, 0, F.lit(head)), line(docs, 1, track_head),
        line(points.withColumn("doc_id", F.col("track_id")), 2, point, order=F.col("seq")),
        line(docs, 3, F.lit("      </coordinates></LineString>\n    </Placemark>")),
        line(folders, 4, F.concat(F.lit("    <Folder>\n      <name>"), T.escape_xml(F.col("category")), F.lit("</name>")), "folder", F.lit(-1)),
        line(placemarks(by_doc).join(folders, ["doc_id", "category"]), 4, F.col("text"), "folder", F.col("_at"), F.col("poi_id")),
        line(folders, 4, F.lit("    </Folder>"), "folder", F.lit((1 << 62))),
        line(docs, 5, F.lit("  </Document>\n</kml>")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_documents(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write documents as text, one folder per ``doc_id``.

    Rows are range-partitioned in document order: a document larger than one task
    spans part files whose names sort in order.
    """
    order = ["doc_id", *[c for c in ("section", "folder", "category", "ord", "tie") if c in lines.columns]]
    ranged = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Write GeoJSON features as one JSON object per line."""
    features.select("feature").write.mode("overwrite").text(path)
