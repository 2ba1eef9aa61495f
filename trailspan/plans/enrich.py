"""Places and landed sources in, enriched places out, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, snippets, structured
from ..operators.pois import google_maps_url, is_generic_name, policy


def gather_sources(places: DataFrame, search: DataFrame, previews: DataFrame, map_previews: DataFrame) -> DataFrame:
    """One row per place: ``place`` (its columns), ``hits`` (its first 16 pages), ``preview``, ``site``, ``map``.

    All sources become rows of one table, keyed by place, and meet in one shuffle. A place gathers at most 16 pages and
    a row of each other source. Every source is scanned once.
    """
    hit = F.struct("pos", "title", "url", "content", "engine")
    rows = [
        places.select("poi_id", F.struct(*places.columns).alias("place")),
        snippets.first_pages(search).select("poi_id", hit.alias("hit")),
        previews.select("poi_id", F.struct("url", "final_url", "title", "description", "excerpt", "structured").alias("preview"), snippets.website_rows().alias("site")),
        map_previews.select("poi_id", F.struct(
            F.col("structured_hours").alias("hours"), snippets.preview_fields().alias("fields"), snippets.map_rows().alias("rows")).alias("map")),
    ]
    tagged = rows[0]
    for more in rows[1:]:
        tagged = tagged.unionByName(more, allowMissingColumns=True)
    only = [F.first(c, ignorenulls=True).alias(c) for c in ("place", "preview", "site", "map")]
    return tagged.groupBy("poi_id").agg(*only, F.sort_array(F.collect_list("hit")).alias("hits")).filter("place IS NOT NULL").drop("poi_id")


def enrich(
    places: DataFrame,
    search: DataFrame,
    previews: DataFrame,
    map_previews: DataFrame,
    language: str = "en",
    enrich_all: bool = False,
) -> DataFrame:
    """Enrichment without a language model.

    ``places``: ``poi_id, name, category, tags, lat, lon, locality, county, state,
    country, n_unresponsive``. Everything after the gathering is an expression on one row per place; only
    full-policy places keep their snippets.
    """
    generic = is_generic_name(F.col("name"))
    effort = F.lit("full") if enrich_all else policy(F.col("category"))
    sources = gather_sources(places, search, previews, map_previews)
    decided = sources.select("place.*", "place", "hits", "preview", "site", "map").withColumn("policy", F.when(generic, "generic").otherwise(effort))
    # Each step is a column of its own: arrays are worked on by interpreted functions that don't share equal parts.
    here = decided.withColumn("hits", snippets.clean_hits(F.col("hits"), F.col("place")))
    united = here.withColumn("hits", snippets.united_hits(F.col("site"), F.col("hits"), F.col("map.rows"), F.col("n_unresponsive")))
    joined = united.withColumn("snippets", F.when(F.col("policy") == "full", snippets.ranked_hits(F.col("hits"))).otherwise(
        F.expr("cast(array() as array<struct<pos:bigint,title:string,url:string,content:string,engine:string>>)")))
    joined = joined.withColumn("_map_hours", F.col("map.hours")).withColumn("_map_fields", F.col("map.fields")).drop("place", "hits", "site", "map")
    found = (F.col("policy") == "full") & (F.size("snippets") > 0)
    visits = F.col("policy").isin("full", "minimal")
    searched = (F.col("policy") == "full")
    # The fallback to a map page happens only where the union asked for it.
    used_map = found & F.exists("snippets", lambda s: s["engine"] == "google_maps")
    web = F.col("preview.structured")
    s = F.col("snippets")
    out = joined.withColumn("preview", F.when(visits, F.col("preview"))).select(
        "*",
        F.when(F.col("policy") == "generic", "skipped").when(F.col("policy") == "skip", "skipped")
        .when(F.col("policy") == "minimal", "done").when(found, "done").otherwise("skipped").alias("status"),
        F.when(F.col("policy") == "generic", "generic-name").when(F.col("policy") == "skip", "low-value-category")
        .when(searched & ~found, "no-results").alias("skip_reason"),
        F.when(found, extract.rating(s, web["rating"])).alias("rating"),
        F.when(found, extract.review_count(s, web["reviewCount"])).alias("review_count"),
        F.when(found, F.coalesce(F.when(used_map, F.col("_map_hours")), extract.structured_hours(s))).alias("opening_hours"),
        F.when(found, extract.hours_text(s, web["openingHours"])).alias("_hours"),
        F.when(found, extract.price_level(s, F.col("category"))).alias("price_level"),
        F.when(found, extract.divergences(s)).otherwise(F.array().cast("array<string>")).alias("divergences"),
        F.lit(None).cast("string").alias("specialty"),
        F.when(found, structured.short_description(language)).alias("description"),
    )
    out = out.withColumn("hours", F.coalesce(
        "_hours", F.when(F.size("opening_hours") > 0, snippets.flatten_hours(F.col("opening_hours")))))
    out = out.withColumn("review", structured.short_review(F.col("rating"), F.col("review_count"), language))
    out = out.withColumn("summary", F.col("description")).withColumn("translated_summary", F.col("description"))
    out = structured.with_structured_content(out, language)
    fields = [F.col(c) for c in ("rating", "review_count", "hours", "description", "review")]
    return out.select(
        *[c for c in places.columns], "policy", "status", "skip_reason", "rating", "review_count", "hours", "opening_hours",
        "description", "review", "summary", "translated_summary", "specialty", "price_level",
        google_maps_url(F.col("name"), F.col("lat"), F.col("lon")).alias("google_maps_url"),
        F.transform("snippets", lambda x: x["url"]).alias("source_urls"), F.col("snippets").alias("raw_snippets"),
        F.when(found, F.col("structured")).alias("structured"), F.when(found, F.col("essentials")).alias("essentials"),
        F.col("preview").alias("official_website"), F.when(found, F.size("snippets")).otherwise(0).alias("source_count"),
        F.array_distinct(F.transform("snippets", lambda x: x["engine"])).alias("source_engines"),
        structured.confidence(s, fields, F.col("preview").isNotNull(), F.size("divergences")).alias("confidence"),
        F.when(found, "deterministic").alias("synthesis_source"), F.when(found, "no-llm").alias("synthesis_reason"),
        F.when(used_map, F.col("_map_fields")).alias("google_maps_fields"),
    )
