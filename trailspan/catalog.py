"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rules, testbed
from .functions.text import js_round
from .operators import corridor, dedup, pois, tracks
from .session import checkpoint_dir, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def metres(column: str):
    return js_round(F.col(column))


def micro(column: str):
    return js_round(F.col(column) * 1e6).alias(f"{column}_e6")


# --- tracks --------------------------------------------------------------------


@query
def track_segments(spark, folder):
    seg = tracks.track_segments(testbed.points(spark, folder))
    return seg.select("track_id", "seg_idx", js_round(F.col("seg_len_m") * 1000).alias("seg_len_mm"))


@query
def track_length(spark, folder):
    out = tracks.track_length(testbed.points(spark, folder))
    return out.select("track_id", metres("total_distance_m").alias("total_distance_m"), "n_points")


@query
def track_cumdist(spark, folder):
    out = tracks.cumulative_distance(testbed.points(spark, folder))
    return out.select("track_id", "seq", metres("cum_m").alias("cum_m"))


@query
def elevation_stats(spark, folder):
    return tracks.elevation_stats(testbed.points(spark, folder)).drop("track_idx")


@query
def resample_track(spark, folder):
    out = tracks.resample(testbed.points(spark, folder))
    return out.select("track_id", "seq", micro("lat"), micro("lon"))


@query
def track_bbox(spark, folder):
    out = tracks.track_bbox(testbed.points(spark, folder))
    return out.select(*[micro(c) for c in out.columns])


@query
def track_rollup(spark, folder):
    out = tracks.track_rollup(testbed.points(spark, folder))
    return out.withColumn("total_distance_m", metres("total_distance_m"))


@query
def track_chunks(spark, folder):
    return tracks.track_chunks(tracks.resample(testbed.points(spark, folder)), 50).drop("track_idx")


# --- categories and corridor -------------------------------------------------------


def _pois(spark, folder) -> DataFrame:
    return pois.categorize(testbed.elements(spark, folder))


@query
def osm_dedup(spark, folder):
    copies = testbed.elements(spark, folder).select(
        "type", "id", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("c")
    ).selectExpr("type", "id", "(id * 5 + c * 3) % 11 AS chunk", "id * 3 + c AS pos", "concat(id, ':', c) AS label")
    return pois.osm_dedup(copies).select("type", "id", "chunk", "label")


@query
def categorize(spark, folder):
    return _pois(spark, folder).select(
        "poi_id", "osm_type", "osm_id", "category", "name", "icon", micro("lat"), micro("lon"),
        F.size("tags").alias("n_tags"),
    )


@query
def tag_predicates(spark, folder):
    chosen = ["Water", "Gears", "Wifi"]
    predicates = pois.tag_predicates(rules.rules_table(spark), chosen)
    hits = (
        pois.prefilter_elements(testbed.elements(spark, folder), chosen)
        .select("type", "id", F.explode("tags").alias("key", "value"))
    )
    counted = hits.join(F.broadcast(predicates), "key").filter(F.array_contains("values", F.col("value")))
    counts = counted.groupBy("key").agg(F.count("*").alias("n_elements"))
    return predicates.join(counts, "key", "left").select("key", F.array_join("values", "|").alias("wanted"), "n_elements")


@query
def segment_distance(spark, folder):
    seg = tracks.track_segments(testbed.points(spark, folder))
    pairs = corridor.near_segments(_pois(spark, folder).select("poi_id", "lat", "lon"), seg, 300.0)
    return pairs.filter("d <= 300").select("poi_id", "seg_idx", metres("d").alias("distance_m"))


def _distances(spark, folder, limit: float = 1500.0) -> DataFrame:
    return corridor.track_distances(_pois(spark, folder), testbed.points(spark, folder), limit)


@query
def distance_to_track(spark, folder):
    return _distances(spark, folder).select("poi_id", "track_id", metres("distance_m").alias("distance_m"))


@query
def corridor_join(spark, folder):
    return _distances(spark, folder, 300.0).select(
        "poi_id", "track_id", metres("distance_m").alias("distance_m"), metres("along_m").alias("along_m")
    )


@query
def corridor_runs(spark, folder):
    """Three users' tracks at once: each place is reported for every run it is near."""
    points = testbed.points(spark, folder).withColumn("run_id", F.concat(F.lit("run"), F.col("track_idx") % 3))
    near = corridor.corridor_filter(_pois(spark, folder), points, 1500.0)
    return near.select("run_id", "poi_id", metres("distance_to_trace").alias("distance_m"))


@query
def along_track(spark, folder):
    near = corridor.nearest_track(_distances(spark, folder))
    return near.select("poi_id", "track_id", metres("along_trace_distance").alias("along_m"))


def _corridor(spark, folder) -> DataFrame:
    return corridor.corridor_filter(_pois(spark, folder), testbed.points(spark, folder))


@query
def corridor_pois(spark, folder):
    from .plans.corridor import corridor_pois as plan

    return plan(testbed.elements(spark, folder), testbed.points(spark, folder)).select(
        "poi_id", "category", "name", "icon", "track_id",
        metres("distance_to_trace").alias("distance_m"), metres("along_trace_distance").alias("along_m"),
    )


@query
def poi_dedup(spark, folder):
    return dedup.dedup_pois(_corridor(spark, folder)).select("poi_id", "category", "n_merged")


@query
def adaptive_radius(spark, folder):
    """Places and merging radius of each of three users' runs."""
    points = testbed.points(spark, folder).withColumn("run_id", F.concat(F.lit("run"), F.col("track_idx") % 3))
    return dedup.run_radius(corridor.corridor_filter(_pois(spark, folder), points, 1500.0))


@query
def distance_sweep(spark, folder):
    """Kept places for each limit and run, after merging with the run's own radius."""
    from .plans.corridor import sweep

    points = testbed.points(spark, folder).withColumn("run_id", F.concat(F.lit("run"), F.col("track_idx") % 2))
    out = sweep(_pois(spark, folder), points, [300, 600, 900, 1500])
    return out.withColumn("sum_distance_m", metres("sum_distance_m"))


@query
def source_region(spark, folder):
    """Places within 1000 m of a track, from elements stored by region: only regions around the tracks are read."""
    from .schemas import ELEMENTS
    from .scratch import scratch_path
    from .sources import regions

    path, points = scratch_path(spark, "elements"), testbed.points(spark, folder)
    regions.write_elements(testbed.elements(spark, folder), path)
    asked = regions.around(spark, path, f"{ELEMENTS}, ord bigint", points)
    near = corridor.track_distances(pois.categorize(asked), points, regions.SOURCE_RADIUS_M)
    return corridor.nearest_track(near).select("poi_id", metres("distance_to_trace").alias("distance_m"))


@query
def distance_counts(spark, folder):
    """Places near for each limit and run, before merging."""
    points = testbed.points(spark, folder).withColumn("run_id", F.concat(F.lit("run"), F.col("track_idx") % 2))
    near = corridor.track_distances(_pois(spark, folder), points, 1500.0)
    return corridor.distance_sweep(near, [300, 600, 900, 1500]).withColumn("sum_distance_m", metres("sum_distance_m"))


# --- sources -----------------------------------------------------------------------


@query
def gpx_ingest(spark, folder):
    from .sources.gpx import parse_gpx

    points, rejects = parse_gpx(testbed.gpx_files(spark, folder))
    kept = points.select(
        F.col("track_id").alias("path"), "name", "seq", micro("lat"), micro("lon"),
        js_round(F.nanvl("ele", F.lit(-1.0)) * 100).alias("ele_cm"), "time", F.lit(None).cast("string").alias("error"),
    )
    lost = rejects.select("path", *[F.lit(None).cast(t).alias(c) for c, t in kept.dtypes[1:-1]], "error")
    return kept.unionByName(lost)


@query
def osm_ingest(spark, folder):
    from .sources.responses import osm_elements

    e = osm_elements(testbed.osm_responses(spark, folder), "json", "n")
    return e.select(
        "n", "pos", "type", "id", js_round(F.coalesce("lat", "center.lat") * 1e6).alias("lat_e6"),
        F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat_ws("=", t["key"], t["value"])), ";").alias("tags"),
    )


@query
def search_ingest(spark, folder):
    from .sources.responses import search_results, unresponsive_engines

    responses = testbed.search_responses(spark, folder)
    results = search_results(responses, "json", "n").select(
        "n", "pos", "title", "url", "engine", F.char_length("content").alias("n_chars")
    )
    down = unresponsive_engines(responses, "json", "n").select(
        "n", "pos", F.lit("").alias("title"), F.col("reason").alias("url"), "engine", F.lit(-1).alias("n_chars")
    )
    return results.unionByName(down)


@query
def geo_context(spark, folder):
    from .sources.responses import geo_context as context

    out = testbed.geocode_responses(spark, folder).select("k", context(F.col("json")).alias("g"))
    return out.select("k", F.col("g").isNotNull().alias("found"), "g.*")


@query
def page_preview(spark, folder):
    from .sources.pages import page_previews

    out = page_previews(testbed.table(spark, folder, "pages"))
    return out.select("page_id", "url", "title", "description", F.md5("excerpt").alias("excerpt_md5"))


@query
def failure_report(spark, folder):
    from .operators import jobs
    from .sources.responses import parse_failures

    return jobs.failure_report(parse_failures(testbed.failure_lines(spark, folder)))


# --- places: filters, counts, labels --------------------------------------------------


@query
def category_filter(spark, folder):
    return pois.category_filter(_pois(spark, folder), ["Water", "Food shop", "Wifi"]).select("poi_id", "category")


@query
def category_counts(spark, folder):
    return pois.category_counts(_pois(spark, folder))


def _ranked(spark, folder, mode: str, collation: str | None) -> DataFrame:
    """Places with their number in the order; the number is given by the order alone, as a report of it."""
    near = corridor.corridor_filter(_pois(spark, folder), testbed.points(spark, folder))
    return near.select("poi_id", "name", F.row_number().over(W.orderBy(*pois.sort_order(mode, collation))).alias("place"))


@query
def poi_sort_distance(spark, folder):
    return _ranked(spark, folder, "distance", None).drop("name")


@query
def poi_sort_name(spark, folder):
    """By name, accents and case aside."""
    return _ranked(spark, folder, "name", "UNICODE_CI_AI")


@query
def poi_sort(spark, folder):
    near = corridor.corridor_filter(_pois(spark, folder), testbed.points(spark, folder))
    return pois.sort_pois(near, "category", None).select("poi_id", "category", metres("distance_to_trace").alias("distance_m"))


@query
def policy_assign(spark, folder):
    return _pois(spark, folder).select("poi_id", pois.policy(F.col("category")).alias("policy"))


@query
def policy_counts(spark, folder):
    return pois.policy_counts(_pois(spark, folder))


@query
def generic_name_filter(spark, folder):
    return _pois(spark, folder).filter(~pois.is_generic_name(F.col("name"))).select("poi_id", "name")


@query
def translate_labels(spark, folder):
    return _pois(spark, folder).select(
        "poi_id", pois.category_label(F.col("category"), "fr").alias("category_fr"),
        pois.category_label(F.col("category"), "en").alias("category_en"), pois.name_label(F.col("name"), "fr").alias("name_fr"),
    )


@query
def icon_lookup(spark, folder):
    return _pois(spark, folder).select("poi_id", pois.osmand_icon("tags", F.col("category")).alias("osmand_icon"))


@query
def availability_flags(spark, folder):
    places = _pois(spark, folder).join(testbed.poi_enrichment(spark, folder).select("poi_id", F.col("hours").alias("known")), "poi_id", "left")
    hours = pois.hours_source(F.col("known"), F.col("tags")["opening_hours"])
    return places.select(
        "poi_id", pois.open_sunday(hours).alias("open_sunday"), pois.open_evening(hours).alias("open_evening"),
        F.array_join(pois.availability_tags(hours), "|").alias("availability"),
    )


@query
def confidence_bands(spark, folder):
    scored = testbed.poi_enrichment(spark, folder).withColumn("band", pois.confidence_band(F.col("confidence")))
    return scored.groupBy("band").agg(F.count("*").alias("n_pois"))


# --- cache and work-lists -----------------------------------------------------------------

AS_OF = "2001-08-01 00:00:00"


def _cache(spark, folder) -> DataFrame:
    from .operators import cache

    return cache.newest(testbed.cache(spark, folder).drop("status"), "version")


@query
def cache_lookup(spark, folder):
    from .operators import cache

    return cache.lookup(_pois(spark, folder), _cache(spark, folder), AS_OF).select("osm_type", "osm_id", "name", "is_stale")


@query
def cache_lookup_stats(spark, folder):
    from .operators import cache

    requests = testbed.table(spark, folder, "events").selectExpr("CASE WHEN event_id % 4 = 0 THEN 'way' ELSE 'node' END AS osm_type", "user_id * 3 AS osm_id")
    return cache.lookup_stats(requests, _cache(spark, folder), AS_OF)


@query
def cache_split(spark, folder):
    from .operators import cache

    flagged = cache.with_reuse(_pois(spark, folder), _cache(spark, folder), AS_OF)
    return flagged.select("poi_id", F.when(F.col("reuse"), "reuse").otherwise("work").alias("action"))


@query
def cache_upsert(spark, folder):
    from .operators import cache

    versions = testbed.cache(spark, folder)
    existing = cache.upsert(versions.limit(0).drop("status"), versions.filter("version % 2 = 0"), "version")
    return cache.upsert(existing, versions.filter("version % 2 <> 0"), "version").select(
        "osm_type", "osm_id", "category", "name", "enrichment", "version", F.date_format("enriched_at", "yyyy-MM-dd").alias("enriched_on")
    )


@query
def pending_worklist(spark, folder):
    from .operators import cache

    return cache.pending(_pois(spark, folder), testbed.poi_enrichment(spark, folder)).select("poi_id", "category")


@query
def enrichment_worklist(spark, folder):
    from .operators import cache

    return cache.worklist(testbed.places(spark, folder)).select(
        "poi_id", "variant", "query", "google_maps_url", "google_directions_url", "yandex_maps_url", "official_site"
    )


@query
def official_site(spark, folder):
    return testbed.elements(spark, folder).select("id", pois.official_site(F.col("tags")).alias("site"))


@query
def geocode_batch(spark, folder):
    from .operators import cache

    places = _pois(spark, folder)
    answered = cache.geocode_requests(places).filter("(lat_key + lon_key) % 3 <> 0").withColumn(
        "locality", F.concat(F.lit("L"), (F.col("lat_key") % 7).cast("string"))
    )
    return cache.attach_geocodes(places, answered).select("poi_id", "lat_key", "lon_key", "locality")


@query
def url_normalize(spark, folder):
    from .functions import urls

    pages = testbed.table(spark, folder, "pages").select("url")
    both = pages.unionByName(testbed.snippets(spark, folder).select("url"))
    return both.select("url", urls.normalize(F.col("url")).alias("page"), urls.host(F.col("url")).alias("host"))


# --- snippets ---------------------------------------------------------------------------


@query
def snippet_dedup(spark, folder):
    from .operators import snippets

    return snippets.dedup(testbed.snippets(spark, folder)).select("poi_id", "pos", "url", F.md5("content").alias("content_md5"))


@query
def snippet_noise(spark, folder):
    from .operators import snippets

    return testbed.snippets(spark, folder).select(
        "poi_id", "pos", snippets.is_noise(F.col("title"), F.col("content"), F.col("url")).alias("is_noise")
    )


@query
def snippet_geo(spark, folder):
    from .operators import snippets

    joined = snippets.dedup(testbed.snippets(spark, folder), None).join(
        testbed.places(spark, folder).select("poi_id", "locality", "county", "state", "country"), "poi_id", "left"
    )
    return joined.select("poi_id", "pos", snippets.is_elsewhere(
        *[F.col(c) for c in ("title", "content", "locality", "county", "state", "country")]).alias("is_elsewhere"))


@query
def snippet_topk(spark, folder):
    from .operators import snippets

    return snippets.clean(testbed.snippets(spark, folder), testbed.places(spark, folder)).select("poi_id", "pos", "title", "engine")


@query
def preview_snippets(spark, folder):
    from .operators import snippets

    return snippets.website_snippets(testbed.previews(spark, folder)).unionByName(
        snippets.map_snippets(testbed.map_previews(spark, folder)))


def _united(spark, folder) -> DataFrame:
    from .operators import snippets

    places = testbed.places(spark, folder)
    return snippets.union_sources(
        snippets.clean(testbed.snippets(spark, folder), places), snippets.website_snippets(testbed.previews(spark, folder)),
        snippets.map_snippets(testbed.map_previews(spark, folder)), places,
    )


@query
def snippet_union(spark, folder):
    return _united(spark, folder).select("poi_id", "pos", "title", "url", "engine")


@query
def snippet_rank(spark, folder):
    from .operators import snippets

    return snippets.rank_by_quality(_united(spark, folder)).select("poi_id", "pos", "url", "score")


@query
def platform_classify(spark, folder):
    from .operators import snippets

    return testbed.snippets(spark, folder).select("poi_id", "pos", snippets.platform(F.col("url")).alias("platform"))


@query
def official_flag(spark, folder):
    from .operators import snippets

    sites = testbed.places(spark, folder).select("poi_id", pois.official_site(F.col("tags")).alias("site"))
    return testbed.snippets(spark, folder).select("poi_id", "pos", "url").join(sites, "poi_id", "left").select(
        "poi_id", "pos", snippets.is_official(F.col("url"), F.col("site")).alias("is_official")
    )


@query
def engine_set(spark, folder):
    from .operators import snippets

    return snippets.engines_seen(testbed.snippets(spark, folder)).select("poi_id", F.array_join("engines", ",").alias("engines"))


# --- extraction ------------------------------------------------------------------------------


def _all_snippets(spark, folder) -> DataFrame:
    """The distinct pages of every place, all of them."""
    from .operators import snippets

    return snippets.dedup(testbed.snippets(spark, folder), None)


def _known(spark, folder, value) -> DataFrame:
    """What a website states itself, for a quarter of the places."""
    return testbed.places(spark, folder).select("poi_id", F.when(F.col("n") % 4 == 1, value).alias("known"))


@query
def price_level(spark, folder):
    from .operators import extract_table

    return extract_table.price_levels(_all_snippets(spark, folder), testbed.places(spark, folder))


@query
def rating_extract(spark, folder):
    from .operators import extract_table

    found = extract_table.ratings(_all_snippets(spark, folder)).join(_known(spark, folder, F.lit(4.5)), "poi_id", "left")
    return found.select("poi_id", F.coalesce("known", "rating").alias("rating"))


@query
def review_count_extract(spark, folder):
    from .operators import extract_table

    found = extract_table.review_counts(_all_snippets(spark, folder)).join(_known(spark, folder, F.lit(99).cast("long")), "poi_id", "left")
    return found.select("poi_id", F.coalesce("known", "review_count").alias("review_count"))


@query
def hours_text_extract(spark, folder):
    from .operators import extract_table

    found = extract_table.hours_texts(_all_snippets(spark, folder)).join(_known(spark, folder, F.lit("Mo-Fr; Sa")), "poi_id", "left")
    return found.select("poi_id", F.coalesce("known", "hours").alias("hours"))


@query
def hours_table(spark, folder):
    from .operators import extract_table, snippets

    found = extract_table.hours_tables(_all_snippets(spark, folder))
    return found.select("poi_id", snippets.flatten_hours(F.col("hours")).alias("hours"))


@query
def divergences(spark, folder):
    from .operators import extract_table

    found = extract_table.divergences(_all_snippets(spark, folder))
    return found.select("poi_id", F.array_join("divergences", "|").alias("divergences"))


@query
def preview_fields(spark, folder):
    from .operators import snippets

    return testbed.map_previews(spark, folder).select("poi_id", F.array_join(snippets.preview_fields(), ",").alias("fields"))


@query
def hours_display(spark, folder):
    from .operators import extract, snippets

    tables = testbed.map_previews(spark, folder).select(
        F.col("poi_id").alias("id"), F.coalesce(snippets.flatten_hours(F.col("structured_hours")), "hours_text").alias("shown"))
    texts = testbed.poi_enrichment(spark, folder).select(
        F.col("poi_id").alias("id"), F.replace(extract.hours_lines(F.col("hours")), F.lit("\n"), F.lit("|")).alias("shown"))
    return tables.unionByName(texts)


# --- map pages, structured data, checks of synthesised texts ---------------------------------


@query
def mappage_extract(spark, folder):
    from .operators import mappages

    return mappages.map_fields(testbed.map_pages(spark, folder)).drop("title", "body_text")


@query
def mappage_hours(spark, folder):
    """The hours text of map pages, from the lines where they show it."""
    from .operators import mappages

    shown = F.array_join(F.slice(F.split("body_text", "\n"), 3, 2), "  ")
    pages = testbed.map_pages(spark, folder).withColumn("hours_text", shown)
    return mappages.map_fields(pages).select("source", "url", "hours")


@query
def hours_rows(spark, folder):
    from .operators import mappages

    return mappages.hours_rows(testbed.map_pages(spark, folder))


@query
def hours_block(spark, folder):
    from .operators import mappages

    return mappages.hours_blocks(testbed.map_pages(spark, folder))


@query
def jsonld_extract(spark, folder):
    from .sources.pages import with_structured_data

    block = """CASE page_id % 6
      WHEN 0 THEN concat('{"@graph":[{"@type":"X","openingHours":["Mo-Fr 09:00-18:00"," Sa  10:00-12:00",""]},{"description":" Sub  ', page_id, ' ","telephone":"+33 1","openingHours":"Mo-Fr 09:00-18:00"}]}')
      WHEN 1 THEN '[{"description":"A place","priceRange":"€€"},{"description":"B","openingHours":"Mo-Su","aggregateRating":{"ratingValue":"4,5","ratingCount":12}}]'
      WHEN 2 THEN '{broken'
      WHEN 3 THEN '{"name":"n","description":{"a":1},"mainEntity":{"description":"Main","mainEntity":[{"telephone":"02 41"}]}}'
      WHEN 4 THEN '{"name":"n","openingHours":[]}'
      ELSE '{"aggregateRating":{"ratingValue":3,"reviewCount":"7"}}' END"""
    pages = testbed.table(spark, folder, "pages").selectExpr(
        "page_id", f"concat(html, '<SCRIPT id=x type=\\'application/ld+json\\'>\n', {block}, '</script>') AS html"
    )
    s = F.col("structured")
    return with_structured_data(pages).select(
        "page_id", s["description"].alias("description"), s["telephone"].alias("telephone"), s["priceRange"].alias("price_range"),
        F.array_join(s["openingHours"], ";").alias("opening_hours"), s["rating"].alias("rating"), s["reviewCount"].alias("review_count"),
    )


@query
def llm_output_gate(spark, folder):
    from .operators import extract, snippets

    p = F.col("parsed")
    return extract.synthesis_gate(testbed.model_outputs(spark, folder)).select(
        "doc_id", p["rating"].alias("rating"), p["review_count"].alias("review_count"), p["price_level"].alias("price_level"),
        snippets.flatten_hours(p["hours"]).alias("hours"), p["description"].alias("description"), p["review"].alias("review"), "reason",
    )


# --- structured content, confidence, enrichment -------------------------------------------------


def _ranked_lists(spark, folder) -> DataFrame:
    from .operators import extract, snippets

    lists = extract.gather(snippets.rank_by_quality(_united(spark, folder)))
    site = testbed.previews(spark, folder).select("poi_id", F.struct("description", "excerpt", "title", "final_url").alias("preview"))
    return lists.join(site, "poi_id", "left")


@query
def source_rollup(spark, folder):
    from .operators import structured

    rolled = _ranked_lists(spark, folder).select("poi_id", structured.source_rollup(F.col("snippets"), F.col("preview")).alias("r"))
    text = F.transform("r", lambda d: F.concat_ws("=", d["platform"], d["brief"], d["url"]))
    return rolled.select("poi_id", F.array_join(text, "|").alias("rollup"))


@query
def source_confirmation(spark, folder):
    from .operators import structured

    rolled = _ranked_lists(spark, folder).select("poi_id", structured.source_rollup(F.col("snippets"), F.col("preview")).alias("r"))
    return rolled.select("poi_id", structured.source_confirmation(F.col("r")).alias("confirmation"))


def _enriched(spark, folder) -> DataFrame:
    from .plans.enrich import enrich

    return enrich(
        testbed.places(spark, folder), testbed.snippets(spark, folder), testbed.previews(spark, folder), testbed.map_previews(spark, folder)
    )


@query
def structured_content(spark, folder):
    s = F.col("structured")
    lists = ("practicalities", "cautions", "unknowns", "divergences")
    return _enriched(spark, folder).filter(s.isNotNull()).select(
        "poi_id", s["headline"].alias("headline"), s["operational_summary"].alias("operational_summary"),
        *[F.array_join(s[n], "|").alias(n) for n in lists], s["source_confirmation"].alias("source_confirmation"), "essentials",
    )


@query
def confidence(spark, folder):
    return _enriched(spark, folder).select("poi_id", "confidence")


@query
def deterministic_enrich(spark, folder):
    return _enriched(spark, folder).select(
        "poi_id", "status", "skip_reason", "rating", "review_count", "hours", "price_level", "description", "review", "source_count",
        F.nullif(F.array_join("google_maps_fields", ","), F.lit("")).alias("google_maps_fields"), "confidence",
    )


@query
def run_summary(spark, folder):
    from .operators import structured

    return structured.run_summary(_enriched(spark, folder))


@query
def engine_failures(spark, folder):
    from .operators import structured

    return structured.engine_failures(testbed.poi_enrichment(spark, folder))


@query
def merge_precedence(spark, folder):
    from .operators import snippets, structured

    n = F.col("n")
    said = F.when(n % 3 == 0, F.array(F.struct(F.lit("All").alias("day"), F.lit("daily").alias("open"), F.lit(None).cast("string").alias("close"))))
    # Even places took the model path, where snippet hours do not stand in.
    maps = testbed.map_previews(spark, folder).select("poi_id", F.col("structured_hours").alias("map_hours"))
    done = _enriched(spark, folder).filter("status = 'done' AND source_count > 0").join(maps, "poi_id", "left")
    from_map = structured.map_hours_of(F.col("raw_snippets"), F.col("map_hours"))
    opening = structured.merged_hours(said, from_map, F.col("opening_hours"), n % 2 == 0)
    return done.select(
        "poi_id", structured.merged(F.when(n % 3 == 0, 5.0), F.col("rating")).alias("rating"),
        structured.merged(F.when(n % 4 == 0, F.lit(1).cast("long")), F.col("review_count")).alias("review_count"),
        structured.merged(snippets.flatten_hours(said), F.col("hours")).alias("hours"), snippets.flatten_hours(opening).alias("opening_hours"),
    )


# --- jobs ---------------------------------------------------------------------------------------


def _job_states(spark, folder) -> DataFrame:
    from .operators import jobs

    return jobs.latest_state(testbed.job_log(spark, folder), "change_no")


@query
def job_latest(spark, folder):
    return _job_states(spark, folder).select("job_id", "status", "source", "attempt", "error")


@query
def job_stats(spark, folder):
    from .operators import jobs

    states = _job_states(spark, folder)
    newest = jobs.latest_jobs(states.withColumn("created_no", F.substring("job_id", 2, 20).cast("long")))
    counts = jobs.job_counts(states, "source").withColumnRenamed("source", "label")
    return counts.unionByName(jobs.job_counts(newest, "job_id").withColumnRenamed("job_id", "label"))


@query
def job_prune(spark, folder):
    from .operators import jobs

    return jobs.prune(_job_states(spark, folder), "2024-01-29 00:00:00").select("job_id", "status")


@query
def request_cache_stats(spark, folder):
    from .operators import jobs
    from .streaming.state import mark_misses

    return jobs.request_cache_stats(mark_misses(testbed.requests(spark, folder), 86_400))


# --- exports ---------------------------------------------------------------------------------------


def _export_pois(spark, folder, enriched: bool) -> DataFrame:
    """Places of the corridor, computed once: a document needs them in several parts."""
    from .sinks.documents import with_enrichment

    checkpoint_dir(spark)
    near = _corridor(spark, folder).checkpoint()
    if not enriched:
        return with_enrichment(near, None)
    none = "CAST(NULL AS STRING)"
    extra = testbed.poi_enrichment(spark, folder).withColumn("structured", F.expr(
        f"named_struct('headline', {none}, 'operational_summary', {none}, 'practicalities', CAST(NULL AS ARRAY<STRING>), "
        "'source_rollup', CAST(NULL AS ARRAY<STRUCT<platform:STRING,brief:STRING,url:STRING>>), 'cautions', cautions, "
        f"'unknowns', CAST(NULL AS ARRAY<STRING>), 'divergences', CAST(NULL AS ARRAY<STRING>), 'source_confirmation', {none})"
    ))
    return with_enrichment(near, extra)


@query
def geojson_export(spark, folder):
    from .sinks.documents import geojson_features

    return geojson_features(_export_pois(spark, folder, False))


@query
def geojson_enriched(spark, folder):
    """Features with all 27 enrichment properties where a place is done."""
    from .sinks.documents import geojson_features

    return geojson_features(_export_pois(spark, folder, True))


def _gpx(spark, folder, osmand: bool) -> DataFrame:
    """Lines of the documents; coordinates to seven places, positions of waypoints to a metre."""
    from .sinks.documents import gpx_lines

    points = testbed.points(spark, folder).withColumn("lat", F.round("lat", 7)).withColumn("lon", F.round("lon", 7)).withColumn("ele", F.round("ele", 3))
    near = _export_pois(spark, folder, True).withColumn("lat", F.round("lat", 7)).withColumn("lon", F.round("lon", 7))
    lines = gpx_lines(near, points, _track_names(spark, folder), osmand)
    metre = F.floor((F.col("ord") + 500) / 1000)
    return lines.withColumn("ord", F.when(F.col("section").isin(2, 4), metre).otherwise(F.col("ord")))


@query
def gpx_plain(spark, folder):
    return _gpx(spark, folder, False)


def _track_names(spark, folder) -> DataFrame:
    return testbed.points(spark, folder).filter("seq = 0").select("track_id", F.concat(F.lit("Route & "), "track_id").alias("name"))


@query
def gpx_export(spark, folder):
    """Documents with the extensions for icons, colours and groups."""
    return _gpx(spark, folder, True)


@query
def kml_export(spark, folder):
    from .sinks.documents import kml_lines

    return kml_lines(_export_pois(spark, folder, True), testbed.points(spark, folder), _track_names(spark, folder))


@query
def compact_desc(spark, folder):
    from .sinks.describe import compact_description

    return _export_pois(spark, folder, True).select("poi_id", compact_description().alias("description"))


# --- table twins of the streams -------------------------------------------------------------------


@query
def engine_health(spark, folder):
    from .operators import jobs

    return jobs.engine_health(testbed.engine_log(spark, folder), "2024-01-30 23:50:00")


@query
def rate_windows(spark, folder):
    from .operators import jobs

    return jobs.rate_windows(testbed.requests(spark, folder), limit=1, minutes=60)


@query
def ttl_misses(spark, folder):
    from .streaming.state import ttl_misses as misses

    return misses(testbed.requests(spark, folder), 86_400)
