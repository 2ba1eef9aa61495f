import glob
import json
import tempfile

from pyspark.sql import functions as F

from trailspan.sinks import documents
from trailspan.sources.gpx import read_gpx

POI = "poi_id string, track_id string, name string, category string, icon string, lat double, lon double, tags map<string,string>, distance_to_trace double, along_trace_distance double"


def places(spark):
    return spark.createDataFrame([
        ("a", "t", "Chez <A> & B", "Restaurant or Bar", "utensils", 48.5, 2.5, {"phone": "01"}, 80.4, 12_345.0),
        ("b", "t", "Fontaine", "Water", "droplet", 48.6, 2.6, {"name": "Other"}, 10.6, 100.0),
    ], POI)


def enriched(spark):
    return spark.sql("""SELECT 'a' AS poi_id, 'done' AS status, 4.3D AS rating, 120L AS review_count, 2 AS price_level, 'Mon: 8:00-18:00; Sun: closed' AS hours,
      array(named_struct('day', 'Mon-Fri', 'open', '08:00', 'close', '18:00'), named_struct('day', 'Sun', 'open', 'closed', 'close', CAST(NULL AS STRING))) AS opening_hours,
      'A fine place' AS description, array('bing', 'aol') AS source_engines, 0.5D AS confidence, 3 AS source_count""")


def test_geojson(spark):
    df = documents.with_enrichment(places(spark), enriched(spark))
    got = {r.poi_id: json.loads(r.feature) for r in documents.geojson_features(df).collect()}
    a, b = got["a"]["properties"], got["b"]["properties"]
    assert got["a"]["geometry"] == {"type": "Point", "coordinates": [2.5, 48.5]}
    assert (a["distanceToTrace"], a["enrichment_rating"], a["enrichment_sourceEngines"], a["enrichment_hours"]) == (80, 4.3, "bing,aol", "Mon: 8:00-18:00; Sun: closed")
    assert a["enrichment_openingHours"] == "Mon-Fri: 08:00-18:00; Sun: Closed" and a["enrichment_specialty"] is None
    assert len([k for k in a if k.startswith("enrichment_")]) == 27
    assert b["name"] == "Other" and not any(k.startswith("enrichment_") for k in b)


def points(spark):
    return spark.createDataFrame([("t", i, 48.0 + i / 100, 2.0, None if i == 1 else 100.0 + i) for i in range(5)], "track_id string, seq long, lat double, lon double, ele double")


def written(spark, lines):
    path = tempfile.mkdtemp(prefix="spark-")
    documents.write_documents(lines, path, 3)
    return path, "\n".join(open(f, encoding="utf8").read().rstrip("\n") for f in sorted(glob.glob(f"{path}/doc_id=t/part-*")))


def test_gpx_document_reads_back(spark):
    tracks = spark.createDataFrame([("t", "My & route")], "track_id string, name string")
    df = documents.with_enrichment(places(spark), enriched(spark))
    _path, text = written(spark, documents.gpx_lines(df, points(spark), tracks, osmand=True))
    assert text.index("Fontaine") < text.index("Chez &lt;A&gt; &amp; B") < text.index("My &amp; route")
    assert "Restaurant or Bar · ★4.3 (120) · $$ · km 12.3 — 80m\nA fine place\nMo-Fr 8-18 · Su closed\n☎ 01" in text
    assert text.index('group name="Water"') < text.index('group name="Restaurant or Bar"')
    folder = tempfile.mkdtemp(prefix="spark-")
    open(f"{folder}/one.gpx", "w", encoding="utf8").write(text)
    open(f"{folder}/bad.GPX", "w").write("<gpx><trk>")
    open(f"{folder}/empty.gpx", "w").write("<gpx></gpx>")
    pts, rejects = read_gpx(spark, folder)
    assert [(r.seq, r.lat, r.ele) for r in pts.orderBy("seq").collect()] == [(i, 48.0 + i / 100, None if i == 1 else 100.0 + i) for i in range(5)]
    assert sorted(r.error for r in rejects.collect()) == ["Invalid GPX file: XML parse error", "No track or route points found in GPX file"]


def test_kml_document(spark):
    tracks = spark.createDataFrame([("t", None, "#e63946")], "track_id string, name string, color string")
    df = documents.with_enrichment(places(spark), enriched(spark))
    _path, text = written(spark, documents.kml_lines(df, points(spark), tracks))
    assert "<color>ff4639e6</color>" in text and text.rstrip().endswith("</kml>")
    assert text.index("<name>Water</name>") < text.index("Fontaine") < text.index("<name>Restaurant or Bar</name>") < text.index("Chez &lt;A&gt;")
    assert text.count("<Folder>") == text.count("</Folder>") == 2
    assert "<b>Rating:</b> ★★★★☆ 4.3/5 (120 reviews)<br/><b>Price:</b> $$<br/><b>Hours:</b><br/>Mon: 8:00-18:00<br/>Sun: closed<br/><i>A fine place</i>" in text
    assert "2.0,48.0,100" in text or "2,48,100" in text


def test_lines_are_dropped_from_the_end(spark):
    from trailspan.sinks.describe import compact_description

    long = spark.sql("SELECT 'a' AS poi_id, 'done' AS status, repeat('word ', 100) AS description, concat('Mon ', repeat('9-10 ', 60)) AS hours")
    df = documents.with_enrichment(places(spark).filter("poi_id = 'a'").withColumn("tags", F.create_map(F.lit("phone"), F.repeat(F.lit("1"), 200))), long)
    text = df.select(compact_description().alias("d")).first().d
    lines = text.split("\n")
    assert len(text) <= 400 and len(lines) == 3 and lines[1].endswith("word…") and len(lines[1]) <= 150
