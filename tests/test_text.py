import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailspan.functions import text as T
from trailspan.functions import urls
from trailspan.operators import cache, extract, mappages, pois, snippets, structured
from trailspan.schemas import SNIPPETS
from trailspan.sources.pages import page_previews


def gathered(spark, *contents, titles=None, category=None):
    rows = [("p", i, titles[i] if titles else "t", f"https://a{i}.example.org/x", c, f"e{i}") for i, c in enumerate(contents)]
    return extract.gather(spark.createDataFrame(rows, SNIPPETS)).withColumn("category", F.lit(category).cast("string"))


def one(df, col):
    return df.select(col.alias("v")).first().v


@pytest.mark.parametrize("contents,category,level", [
    (["Price range: €"], None, None), (["Price: €€ — moderate pricing"], None, 2), (["rated $$$ by maps"], None, 3), (["€€€€ — fine"], None, 4),
    (["Google Maps says: €€", "Tripadvisor: €€€€ — expensive"], None, 4), (["Budget: €€", "Price: €€€", "Listed as €€€€"], None, 3), (["Price: € €"], None, 2),
    (["Rated as Inexpensive"], None, 1), (["bon marché idéal"], None, 1), (["des prix moyens"], None, 2), (["Un peu cher mais"], None, 3),
    (["Classified as Very Expensive"], None, 4), (["C'est très cher pour"], None, 4), (["il faut chercher"], None, None), (["c'est pas cher ici"], None, 1),
    (["menu 25,90€"], None, 3), (["plat €7"], None, 1), (["12€ et 18€"], None, 2), (["nuit 18€"], "Sleeping place", 1), (["55€"], "Sleeping place", 2),
    (["120€"], "Sleeping place", 3), (["250€"], "Sleeping place", 4), (["nothing"], None, None),
])
def test_price_ladder(spark, contents, category, level):
    df = gathered(spark, *contents, category=category)
    assert one(df, extract.price_level(F.col("snippets"), F.col("category"))) == level


def test_legacy_price_reads_the_last_word(spark):
    df = gathered(spark, "c'est pas cher ici")
    assert one(df, extract.price_level(F.col("snippets"), F.col("category"), legacy=True)) == 3


def test_fields(spark):
    df = gathered(spark, "Noted 7/5, then 4,2/5 and 3 stars", "1,250 reviews. Mon to Fri 8:00-18:00; later")
    s = F.col("snippets")
    assert one(df, extract.rating(s)) == 4.2
    assert one(df, extract.rating(s, F.lit(4.9))) == 4.9
    assert one(df, extract.review_count(s)) == 250
    assert one(df, extract.hours_text(s)) == "Mon to Fri 8:00-18:00"


def hours_of(spark, *contents):
    value = one(gathered(spark, *contents), extract.structured_hours(F.col("snippets")))
    return None if value is None else [(h["day"], h["open"], h["close"]) for h in value]


def test_structured_hours(spark):
    assert hours_of(spark, "Lundi 08h30-19h00, Mardi 9h00-18h00") == [("Mon", "08:30", "19:00"), ("Tue", "09:00", "18:00")]
    assert hours_of(spark, "Monday 8:00-12:00", "Monday 9:00-10:00 Tuesday 9:00-10:00")[0] == ("Mon", "08:00", "12:00")
    assert hours_of(spark, "fermé le dimanche. Samedi 10:00-12:00") == [("Sat", "10:00", "12:00"), ("Sun", "closed", None)]
    assert hours_of(spark, "Monday 8:00-12:00 only") is None


def test_divergences(spark):
    df = gathered(spark, "open 9:00-12:00, 4.5/5", "ouvert 10:00-12:00, 3.2 stars, permanently closed")
    got = one(df, extract.divergences(F.col("snippets")))
    assert len(got) == 3 and got[1] == "Rating varies across sources (3.2 to 4.5/5)." and "may be closed" in got[2]
    assert one(gathered(spark, "fine"), extract.divergences(F.col("snippets"))) == []


def test_snippet_order_and_noise(spark):
    rows = [
        ("p", 0, "a", "https://www.x.org/a/?utm_source=1", "first", "e"), ("p", 1, "b", "https://x.org/a", "second", "e"),
        ("p", 2, "c", "https://twitter.com/q", "third", "e"), ("p", 3, "d", "https://www.tripadvisor.fr/r", "s", "e"),
        ("p", 4, "e", "https://linkedin.com/q", "fifth", "e"), ("p", 5, "Login", "https://y.org", "x", "e"), ("p", 6, "Привет", "https://z.org", "мир", "e"),
    ]
    df = spark.createDataFrame(rows, SNIPPETS)
    kept = snippets.dedup(df)
    assert sorted(r.pos for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    clean = kept.filter(~snippets.is_noise(F.col("title"), F.col("content"), F.col("url")))
    ranked = snippets.rank_by_quality(clean).orderBy("pos").collect()
    assert [r.url for r in ranked] == ["https://www.tripadvisor.fr/r", "https://www.x.org/a/?utm_source=1"]
    legacy = df.filter("pos = 6").select(snippets.is_noise(F.col("title"), F.col("content"), F.col("url"), legacy=True).alias("v")).first().v
    assert legacy is False


def test_elsewhere(spark):
    rows = [("Deni's, Torrevieja", "food", True), ("Hotel - Saumur", "x", False), ("Hotel du Port - Lyon", "x", True), ("Menu, Le", "x", False), ("Best in Berlin", "near Saumur", False), ("Plain", "x", False)]
    df = spark.createDataFrame(rows, "title string, content string, want boolean")
    cols = [F.lit(x).cast("string") for x in ("Saumur", "Maine-et-Loire", None, "France")]
    assert all(r.want == r.got for r in df.withColumn("got", snippets.is_elsewhere(F.col("title"), F.col("content"), *cols)).collect())
    none = [F.lit(None).cast("string")] * 4
    assert not any(r.got for r in df.withColumn("got", snippets.is_elsewhere(F.col("title"), F.col("content"), *none)).collect())


def test_urls_and_platforms(spark):
    cases = {
        "https://WWW.Example.com/a/?utm_source=x&b=2#f": "https://example.com/a?b=2#f", "https://m.yelp.com": "https://yelp.com/", "http://x.org:8080/p/": "http://x.org:8080/p",
        "not a url": "not a url", "https://x.org/?ref=1": "https://x.org/", "https://x.org/a?flag": "https://x.org/a?flag=",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string").withColumn("got", urls.normalize(F.col("u")))
    assert all(r.got == r.want for r in df.collect())
    p = spark.createDataFrame([("https://maps.google.com/x", "google_maps"), ("https://fr.hotels.com", "hotels_com"), ("nope", "other")], "u string, want string")
    assert all(r.got == r.want for r in p.withColumn("got", snippets.platform(F.col("u"))).collect())


def test_official_site(spark):
    df = spark.createDataFrame([('{"website":"https://www.facebook.com/x","url":"bakery.fr/menu"}', "https://bakery.fr/menu"), ('{"website":"https://tripadvisor.xyz/a"}', None),
                                ('{"contact:website":" http://ok.example "}', "http://ok.example"), ('{"website":"no site"}', None)], "j string, want string")
    got = df.select("want", pois.official_site(F.from_json("j", "map<string,string>")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_search_text_cleaning(spark):
    df = spark.createDataFrame([("Le Zinc (closed)", "Le Zinc"), ("Bar du Port - fermé depuis 2020", "Bar du Port"), ("  A  ", "A"), ("", "")], "n string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", cache.clean_name(F.col("n"))).collect())


def test_availability(spark):
    rows = [("Mo-Su 08:00-22:00", True, True), ("Mo-Fr 09:00-18:00; Su closed", False, False), ("Sunday 10:00-13:00", True, False), ("7j/7 8h-23h", True, True), ("", False, False), ("Fr 18:00-02:00", False, True)]
    df = spark.createDataFrame(rows, "h string, sun boolean, eve boolean")
    assert all((r.sun, r.eve) == (r.s, r.e) for r in df.select("*", pois.open_sunday(F.col("h")).alias("s"), pois.open_evening(F.col("h")).alias("e")).collect())


ROWS = [
    ("google", "Monday 9:00 AM – 6:00 PM", ("Mon", "09:00", "18:00")), ("google", "Lundi 9h00 – 18h00", ("Mon", "09:00", "18:00")), ("google", "Sunday Closed", ("Sun", "closed", None)),
    ("google", "some random text without day", None), ("google", "Friday 12:00 AM-11:30 PM", ("Fri", "00:00", "23:30")), ("google", "Friday Open 24 hours", ("Fri", "00:00", "23:59")),
    ("yandex", "Понедельник 9:00 – 18:00", ("Mon", "09:00", "18:00")), ("yandex", "Pazartesi 09:00 - 22:00", ("Mon", "09:00", "22:00")), ("yandex", "Воскресенье выходной", ("Sun", "closed", None)),
    ("yandex", "Pazar kapalı", ("Sun", "closed", None)), ("yandex", "Cuma 24 saat", ("Fri", "00:00", "23:59")), ("yandex", "Monday", None), ("yandex", "Salı 8.30-17.00", ("Tue", "08:30", "17:00")), ("yandex", "Friday 25:00 - 26:00", None),
]


def test_hours_lines_of_map_pages(spark):
    df = spark.createDataFrame([(i, s, line) for i, (s, line, _w) in enumerate(ROWS)], "i int, source string, line string")
    got = {r.i: r.row and tuple(r.row) for r in mappages.with_hours_row(df).collect()}
    assert got == {i: w for i, (_s, _l, w) in enumerate(ROWS)}


def test_hours_block_stops_after_three_misses(spark):
    body = "Head\nMonday 9:00 AM–5:00 PM\nx\ny\nTuesday Closed\na\nb\nc\nFriday 9:00 AM–5:00 PM"
    df = spark.createDataFrame([("google", "u", "t", body), ("google", "v", "t", "Monday 9:00 AM–5:00 PM\nend")], "source string, url string, title string, body_text string")
    assert [(r.url, r.day) for r in mappages.hours_blocks(df).orderBy("line_no").collect()] == [("u", "Mon"), ("u", "Tue")]


def test_map_fields(spark):
    rows = [
        ("google", "u", "Chez A - Google Maps", "x Chez A\n4,3 (1 280) · Restaurant · open\nNearby places 4.9", 4.3, 1280, "Restaurant"), ("google", "u", "Chez B", "Chez B 9.9 and 4.2", None, None, None),
        ("yandex", "u", None, "Кафе · 4,7 · 126 оценок", 4.7, 126, "Кафе"), ("yandex", "u", None, "x" * 900 + " 4,5", None, None, None), ("yandex", "u", None, "noise 0,5 then 50 yorum", None, 50, None),
    ]
    df = spark.createDataFrame(rows, "source string, url string, title string, body_text string, r double, n long, c string")
    for r in mappages.map_fields(df).collect():
        assert (r.rating, r.review_count, r.category) == (r.r, r.n, r.c), r.body_text


def test_synthesis_gate(spark):
    rows = [
        ('{"rating":4.26,"description":"Nice stop. More text","review":"Good place"}', "en", None), ('```json\n{"rating": 3}\n```', "en", None), ("no json", "en", "invalid-json"),
        ('{"review":"Une adresse avec terrasse."}', "en", "bad-language"), ('{"review":"Rated well."}', "fr", "bad-language"), ('{"review":"Wow!!!!"}', "en", "unreadable"), ('{"review":"ok"}', "en", "unreadable"),
    ]
    df = extract.synthesis_gate(spark.createDataFrame(rows, "raw string, language string, want string"))
    got = df.collect()
    assert all(r.reason == r.want for r in got)
    assert got[0].parsed.rating == 4.3 and got[0].parsed.description == "Nice stop."


def test_synthesis_gate_at_the_length_limit(spark):
    """A sentence of 180 characters and its end sign is kept whole and not too long; one without an end is cut."""
    words = ("calm stop " * 18).strip() + "s"
    rows = [(words + sign + " More.", words + sign) for sign in ".!?"] + [(words + " and no end", words)]
    assert len(words) == 180
    df = spark.createDataFrame([('{"description":"%s"}' % said, "en", want) for said, want in rows], "raw string, language string, want string")
    assert [(r.parsed.description, r.reason) for r in extract.synthesis_gate(df).collect()] == [(want, None) for _, want in rows]


def test_page_preview(spark):
    html = "<html><head><TITLE>A\n b</TITLE><meta content='the desc' name='description'><script>var x='<p>'</script></head><body><style>p{}</style><p>Hello</p> <b>you</b></body></html>"
    r = page_previews(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert (r.title, r.description, r.excerpt, r.structured) == ("A b", "the desc", "A b Hello you", None)


def test_cache_rules(spark):
    ts = dt.datetime(2024, 1, 1)
    versions = [("node", 1, "Water", 1.0, 1.0, "old", "{}", ts, 1, "done"), ("node", 1, "Water", 1.0, 1.0, "new", "{}", ts + dt.timedelta(days=1), 2, "done"),
                ("node", 1, "Water", 1.0, 1.0, "failed", "{}", ts + dt.timedelta(days=9), 3, "error"), ("way", 0, "Water", 1.0, 1.0, "no id", "{}", ts, 4, "done"), ("way", 2, "", 1.0, 1.0, "no category", "{}", ts, 5, "done")]
    df = spark.createDataFrame(versions, "osm_type string, osm_id long, category string, lat double, lon double, name string, enrichment string, enriched_at timestamp, version long, status string")
    now = cache.upsert(df.limit(0).drop("status"), df, "version")
    assert [r.name for r in now.collect()] == ["new"]
    found = cache.lookup(df.select("osm_type", "osm_id"), now, "2024-04-02 00:00:01", 90).collect()
    assert len(found) == 1 and found[0].is_stale is True
    assert cache.lookup(df, now, "2024-04-01 00:00:00", 90).first().is_stale is False


def test_one_decimal_of_null_is_null(spark):
    assert one(spark.range(1), T.one_decimal(F.lit(None).cast("double"))) is None


def test_source_confirmation(spark):
    d = "array<struct<platform:string,brief:string,url:string>>"
    for names, want in ((["google_maps"], "reviews-only"), (["official_website"], "official"), (["official_website", "yelp"], "both"), (["facebook"], "none"), ([], "none")):
        rows = F.transform(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.struct(n.alias("platform"), n.alias("brief"), n.alias("url"))).cast(d)
        assert one(spark.range(1), structured.source_confirmation(rows)) == want


def test_json_ld_of_any_depth(spark):
    from trailspan.sources.pages import jsonld_nodes

    block = '<script type="application/ld+json">%s</script>'
    deep = '{"name":"n0"}'
    for k in range(1, 8):
        deep = '{"name":"n%d","%s":%s}' % (k, "mainEntity" if k % 2 else "@graph", deep if k % 2 else f"[[{deep}],1,null]")
    pages = [
        (0, block % deep, [f"n{k}" for k in range(7, -1, -1)]),
        (1, block % '[[{"name":"a"},[{"name":"b"}]],{"name":"c"}]', ["a", "b", "c"]),
        (2, block % '{"name":"p","mainEntity":[{"name":"r"}],"@graph":[{"name":"q","@graph":[{"name":"s"}]}]}', ["p", "q", "s", "r"]),
        (3, block % "no json" + block % '{"name":"x"}', ["x"]), (4, "no block", []), (5, block % '{"name":"o","@graph":{"name":"not a list"}}', ["o"]),
    ]
    df = spark.createDataFrame([(k, h) for k, h, _ in pages], "k int, html string")
    names = F.transform(jsonld_nodes(F.col("html")), lambda n: F.try_variant_get(n, "$.name", "string"))
    assert {r.k: r.names for r in df.select("k", names.alias("names")).collect()} == {k: w for k, _, w in pages}


def test_fields_of_whole_tables(spark):
    from trailspan.operators import extract_table as X

    rows = [("p", k, "t", f"u{k}", c, "e") for k, c in enumerate(
        ["nothing"] * 20 + ["Rated 4,5/5 from 12 reviews, open Monday 08:00-12:00", "3/5 and 99 reviews $$", "Monday 09:00-10:00 Tuesday 9h00-11h00 $$$", "10 € or 30€, permanently closed", "€€€€ very nice"])]
    rows += [("q", 0, "t", "u", "12 € 40 €", "e"), ("r", 0, "t", "u", "cheap", "e"), ("s", 0, "t", "u", "", "e")]
    df = spark.createDataFrame(rows, "poi_id string, pos int, title string, url string, content string, engine string")
    places = spark.createDataFrame([("p", "Food"), ("q", "Food"), ("q2", "x")], "poi_id string, category string")
    one = lambda out, c: {r.poi_id: r[c] for r in out.collect()}
    assert one(X.ratings(df), "rating") == {"p": 4.5, "q": None, "r": None, "s": None}
    assert one(X.review_counts(df), "review_count")["p"] == 12
    assert one(X.hours_texts(df), "hours")["p"].startswith("Monday 08:00")
    week = one(X.hours_tables(df), "hours")
    assert [(d.day, d.open, d.close) for d in week["p"]] == [("Mon", "08:00", "12:00"), ("Tue", "09:00", "11:00")] and week["q"] is None
    assert one(X.price_levels(df, places), "price_level") == {"p": 3, "q": 3, "r": 1, "s": None}
    said = one(X.divergences(df), "divergences")
    assert len(said["p"]) == 2 + 1 and said["q"] == []


def test_gpx_with_empty_parts_and_prefixes(spark):
    from trailspan.sources.gpx import parse_gpx

    point = '<trkpt lat="%d" lon="1"><ele>5</ele></trkpt>'
    files = [
        ("a.gpx", f"<gpx><trk/><trk><trkseg/><trkseg>{point % 1}</trkseg></trk><trk><name>x</name></trk><trk><trkseg>{point % 2}</trkseg></trk></gpx>"),
        ("b.gpx", f'<g:gpx xmlns:g="u"><g:trk><g:trkseg><g:trkpt lat="3" lon="1"/></g:trkseg></g:trk></g:gpx>'),
        ("c.gpx", '<gpx><rte/><rte><rtept lat="4" lon="1"/></rte><rte><name>n</name></rte></gpx>'),
        ("d.gpx", "<gpx><trk><trkseg/></trk></gpx>"), ("e.gpx", "<gpx><trk"),
    ]
    points, rejects = parse_gpx(spark.createDataFrame(files, "path string, content string"))
    assert sorted((r.track_id, r.seq, r.lat) for r in points.collect()) == [("a.gpx", 0, 1.0), ("a.gpx", 1, 2.0), ("b.gpx", 0, 3.0), ("c.gpx", 0, 4.0)]
    assert sorted(r.path for r in rejects.collect()) == ["d.gpx", "e.gpx"]
