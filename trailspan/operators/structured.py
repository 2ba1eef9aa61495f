"""Structured content, confidence and status of an enriched place.

All inputs of a place are columns of one row: ``snippets`` (at most eight, as an
array), ``preview`` (website preview struct), the place's own columns and the
fields extracted before. Nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions import urls
from . import snippets as S
from .pois import policy

_DIGEST = "array<struct<platform:string,brief:string,url:string>>"


def _label(name: str) -> str:
    return rules.PLATFORMS[name][0]


def source_rollup(snippets: Column, preview: Column) -> Column:
    """One digest per platform, by display priority: its longest snippet.

    The website preview stands in for an official site no snippet covers.
    """
    numbered = F.transform(snippets, lambda s, i: F.struct(
        F.char_length(s["content"]).alias("size"), (-i).alias("early"), s["url"].alias("url"),
        s["content"].alias("content"), S.platform(s["url"]).alias("platform"),
    ))
    described = T.blank_to_null(preview["description"]).isNotNull() | T.blank_to_null(preview["excerpt"]).isNotNull() | T.blank_to_null(preview["title"]).isNotNull()
    site_text = F.coalesce(preview["description"], preview["excerpt"], preview["title"], F.lit(""))

    def digest(name: str, text: Column, url: Column) -> Column:
        brief = F.concat(F.lit(f"{_label(name)}: "), T.shorten(text, 180))
        return F.struct(F.lit(name).alias("platform"), brief.alias("brief"), url.alias("url"))

    def digests(numbered: Column) -> list[Column]:
        found = []
        for name in sorted(rules.PLATFORMS, key=lambda n: rules.PLATFORMS[n][1]):
            if name == "official_website":
                found.append(F.when(F.coalesce(described, F.lit(False)), digest(name, site_text, preview["final_url"])))
            else:
                best = F.array_max(F.filter(numbered, lambda s: s["platform"] == name))
                found.append(T.let(best, lambda b: F.when(b.isNotNull(), digest(name, b["content"], b["url"]))))
        return found

    return T.let(numbered, lambda n: F.array_compact(F.array(*digests(n)))).cast(_DIGEST)


def _platforms(rollup: Column) -> Column:
    return F.transform(rollup, lambda d: d["platform"])


def source_confirmation(rollup: Column) -> Column:
    """Whether the official site, review platforms, both or none speak for a place."""
    names = _platforms(rollup)
    official = F.array_contains(names, "official_website")
    reviews = F.arrays_overlap(names, F.array(*[F.lit(p) for p in rules.REPUTATION_PLATFORMS]))
    return F.when(official & reviews, "both").when(official, "official").when(reviews, "reviews-only").otherwise("none")


def _rating_text(rating: Column) -> Column:
    return T.one_decimal(rating)


def _osm_type(*keys: str) -> Column:
    return F.coalesce(*[F.col("tags")[k] for k in keys])


def practicalities(language: str = "en") -> Column:
    """Up to six short facts, in fixed order."""
    kind = _osm_type("cuisine", "amenity", "shop", "tourism")
    rating = F.concat(F.lit("Reported rating: "), _rating_text(F.col("rating")), F.lit("/5"))
    phone = F.coalesce(T.blank_to_null(F.col("tags")["phone"]), T.blank_to_null(F.col("tags")["contact:phone"]))
    specialty = T.blank_to_null(F.col("specialty"))
    facts = F.array(
        F.concat(F.lit("Type: "), specialty),
        F.when(
            specialty.isNull() & (kind != "") & (kind != F.lower("name")),
            F.concat(F.lit("Type (OSM): "), F.replace(kind, F.lit("_"), F.lit(" "))),
        ),
        F.when(F.col("review_count").isNotNull(), F.concat(rating, F.lit(" ("), F.col("review_count").cast("string"), F.lit(" reviews)"))).otherwise(rating),
        F.concat(F.lit("Hours: "), T.blank_to_null(F.col("hours"))),
        F.concat(F.lit("Price level: "), F.repeat(F.lit("$"), F.col("price_level"))),
        F.concat(F.lit("Phone: "), phone),
        F.concat(F.lit("Localité: " if language == "fr" else "Locality: "), T.blank_to_null(F.col("locality"))),
    )
    return F.slice(T.unique_texts(facts), 1, 6)


def cautions(rollup: Column) -> Column:
    """Up to four warnings about thin or missing sources."""
    full = policy(F.col("category")) == "full"
    none = F.size(rollup) == 0
    reputation = F.exists(_platforms(rollup), lambda p: p.isin(*rules.REPUTATION_PLATFORMS))
    weak = F.coalesce(
        T.lookup(rules.CONTRACT_WEAK_SOURCE, F.col("category")), F.lit("No identifiable review or discovery platform found.")
    )
    return F.slice(T.compact_array(
        F.when(none, weak),
        F.when(full & F.col("rating").isNull(), F.lit("No explicit rating found in the collected sources.")),
        F.when(full & F.col("hours").isNull(), F.lit("Opening hours were not confirmed from the collected sources.")),
        F.when(full & F.col("review_count").isNull() & F.col("rating").isNotNull(), F.lit("Rating found, but review volume was not confirmed.")),
        F.when(~none & ~reputation, F.lit("Sources are limited to social profiles or generic directories — reliability uncertain.")),
    ), 1, 4)


def unknowns(rollup: Column) -> Column:
    return T.compact_array(F.when(
        F.col("specialty").isNull() & (F.size(rollup) > 0),
        F.lit("Exact type or specialty could not be determined from sources."),
    ))


# What a place of each category is to a rider.
LEAD = {
    "Restaurant or Bar": "food stop near the route.",
    "Food shop": "food resupply option near the route.",
    "Sleeping place": "sleep option near the route.",
    "Gears": "bike gear or repair stop near the route.",
}


def category_lead() -> Column:
    kind = _osm_type("amenity", "shop", "tourism")
    bracket = F.when(kind != "", F.concat(F.lit(" ("), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(")")))
    lead = T.lookup(LEAD, F.col("category"))
    return F.coalesce(
        F.concat(F.col("name"), F.coalesce(bracket, F.lit("")), F.lit(" — "), lead),
        F.concat(F.col("name"), F.lit(" — "), F.lower("category"), F.lit(" near the route.")),
    )


def operational_summary(rollup: Column, divergences: Column) -> Column:
    labels = F.transform(_platforms(rollup), lambda p: T.lookup({n: v[0] for n, v in rules.PLATFORMS.items()}, p))
    parts = F.array(
        F.concat(F.lit("Best read as "), T.blank_to_null(F.col("specialty")), F.lit(".")),
        F.when(T.blank_to_null(F.col("hours")).isNotNull(), F.lit("Hours available.")).otherwise(F.lit("Hours unclear.")),
        F.when(F.col("rating").isNotNull(), F.lit("Reputation signals present.")).otherwise(F.lit("Reputation signals limited.")),
        F.when(F.size(rollup) > 0, F.concat(F.lit("Coverage: "), F.array_join(labels, ", "), F.lit("."))),
        F.when(F.size(divergences) > 0, F.lit("Some source disagreements detected.")),
    )
    return T.blank_to_null(T.shorten(F.array_join(T.unique_texts(parts), " "), 240))


def essentials(c: Column) -> Column:
    """The structured content as one text of at most 700 characters."""
    def part(prefix: str, list_name: str, joiner: str = " ", suffix: str = "") -> Column:
        return F.when(F.size(c[list_name]) > 0, F.concat(F.lit(prefix), F.array_join(c[list_name], joiner), F.lit(suffix)))

    parts = F.array(
        c["headline"], c["operational_summary"], part("Key facts: ", "practicalities", "; ", "."),
        part("Divergences: ", "divergences"), part("Cautions: ", "cautions"), part("Unknown: ", "unknowns"),
    )
    return T.blank_to_null(T.shorten(F.array_join(T.unique_texts(parts), " "), 700))


def with_structured_content(places: DataFrame, language: str = "en") -> DataFrame:
    """Adds ``structured`` and ``essentials``.

    Needs the place columns, ``snippets``, ``preview``, the extracted fields,
    ``divergences``, ``summary`` and ``translated_summary``.
    """
    out = places.withColumn("_rollup", source_rollup(F.col("snippets"), F.col("preview")))
    rollup = F.col("_rollup")
    headline = T.blank_to_null(T.shorten(F.coalesce("translated_summary", "summary", category_lead()), 320))
    out = out.withColumn("structured", F.struct(
        headline.alias("headline"), operational_summary(rollup, F.col("divergences")).alias("operational_summary"),
        practicalities(language).alias("practicalities"), rollup.alias("source_rollup"),
        cautions(rollup).alias("cautions"), unknowns(rollup).alias("unknowns"),
        F.col("divergences").alias("divergences"), source_confirmation(rollup).alias("source_confirmation"),
    ))
    return out.withColumn("essentials", essentials(F.col("structured"))).drop("_rollup")


def confidence(snippets: Column, fields: list[Column], has_site: Column, n_divergences: Column) -> Column:
    """Score in [0, 1] from sources, their variety, the fields found and disagreements."""
    n = F.size(snippets)
    engines = F.size(F.array_distinct(F.transform(snippets, lambda s: s["engine"])))
    hosts = F.size(F.array_distinct(F.array_compact(F.transform(snippets, lambda s: urls.host(s["url"])))))
    length = F.aggregate(snippets, F.lit(0), lambda acc, s: acc + F.char_length(F.coalesce(s["content"], F.lit(""))))
    quality = F.least(length / n / 1500, F.lit(0.10)) + F.least(hosts * 0.025, F.lit(0.05))
    present = reduce(lambda a, b: a + b, [F.when(f.isNotNull(), 1).otherwise(0) for f in fields])
    raw = (
        F.least(n / 15, F.lit(0.40)) + F.least(engines * 0.05, F.lit(0.15)) + F.least(present * 0.04, F.lit(0.20))
        + F.when(has_site, 0.10).otherwise(0.0) + F.least(quality, F.lit(0.15)) - F.least(n_divergences * 0.05, F.lit(0.15))
    )
    score = F.least(F.greatest(F.floor(raw * 100 + 0.5) / 100, F.lit(0.0)), F.lit(1.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(score)


def short_description(language: str = "en") -> Column:
    kind = F.replace(F.coalesce(_osm_type("amenity", "shop", "tourism"), F.col("category")), F.lit("_"), F.lit(" "))
    tail = "arrêt utile près de l'itinéraire." if language == "fr" else "useful stop near the route."
    return F.substring(F.concat(F.col("name"), F.lit(", "), kind, F.lit(f", {tail}")), 1, 180)


def short_review(rating: Column, count: Column, language: str = "en") -> Column:
    score, n = _rating_text(rating), count.cast("string")
    if language == "fr":
        both = F.concat(F.lit("Avis web: "), score, F.lit("/5 sur "), n, F.lit(" avis."))
        one = F.concat(F.lit("Avis web: "), score, F.lit("/5."))
        volume = F.concat(F.lit("Volume d'avis confirmé: "), n, F.lit("."))
    else:
        both = F.concat(F.lit("Web reviews: "), score, F.lit("/5 from "), n, F.lit(" reviews."))
        one = F.concat(F.lit("Web reviews: "), score, F.lit("/5."))
        volume = F.concat(F.lit("Review volume confirmed: "), n, F.lit("."))
    return F.coalesce(both, one, volume)


def merged(synthesis: Column, deterministic: Column) -> Column:
    """Synthesised value when there is one, else the deterministic one."""
    return F.coalesce(synthesis, deterministic)


def map_hours_of(snippets: Column, map_hours: Column) -> Column:
    """The map page's hours table, where the map page is among a place's sources."""
    return F.when(F.exists(snippets, lambda s: s["engine"] == "google_maps"), map_hours)


def merged_hours(said: Column, from_map: Column, from_snippets: Column, by_model: Column) -> Column:
    """Opening hours by precedence: what the model said; else the map's on the model path, the snippets' off it."""
    return F.coalesce(said, F.when(by_model, from_map).otherwise(from_snippets))


def run_summary(enriched: DataFrame) -> DataFrame:
    """Places per status, in one row."""
    return enriched.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "skipped", "error")])


def engine_failures(enriched: DataFrame, order: str = "ord") -> DataFrame:
    """First reason per silent engine over all places, in place order."""
    down = enriched.select(order, F.posexplode("unresponsive_engines").alias("pos", "u"))
    return down.groupBy(F.col("u.engine").alias("engine")).agg(
        F.min_by("u.reason", F.struct(order, "pos")).alias("reason"), F.count("*").alias("n_places")
    )
