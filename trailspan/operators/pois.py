"""Categories, labels, filters and counts over map elements and POIs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions import urls
from .newest import first_rows


def osm_dedup(elements: DataFrame, order: Iterable[str] = ("chunk", "pos")) -> DataFrame:
    """First row per (type, id) in source order, decided without tags, see ``first_rows``."""
    return first_rows(elements, ["type", "id"], order)


def _tag_text(entry: Column) -> Column:
    return F.concat_ws("=", entry["key"], entry["value"])


def _listed(entry: str, listed: Iterable[str]) -> str:
    values = ", ".join(T.sql_text(v) for v in listed)
    return f"concat_ws('=', {entry}.key, {entry}.value) IN ({values})"


def listed_tags(tags: str, listed: Iterable[str]) -> Column:
    """Tags whose ``key=value`` is listed, in tag order."""
    return F.expr(f"filter(map_entries({tags}), e -> {_listed('e', listed)})")


def first_listed_tag(tags: str, listed: Iterable[str]) -> Column:
    """First tag, in tag order, whose ``key=value`` is listed; null if none."""
    return F.get(listed_tags(tags, listed), F.lit(0))


def categorize(elements: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
    """Elements to POIs: coordinate, category, icon and display name.

    Works row by row: no shuffle and no dimension join.
    """
    node = F.col("type") == "node"
    located = (
        elements.withColumn("_lat", F.when(node, F.col("lat")).otherwise(F.col("center.lat")))
        .withColumn("_lon", F.when(node, F.col("lon")).otherwise(F.col("center.lon")))
        .filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
        # Exploding the first hit drops elements without one. A filter would be pushed
        # below and search the tags a second time.
        .withColumn("_hit", F.explode(F.slice(listed_tags("tags", rules.CATEGORY_BY_TAG), 1, 1)))
    )
    tag = _tag_text(F.col("_hit"))
    fallback = T.first_upper(F.replace(F.col("_hit")["value"], F.lit("_"), F.lit(" ")))
    keep = [c for c in elements.columns if c not in ("type", "id", "lat", "lon", "center", "tags")]
    pois = located.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("poi_id"),
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"),
        F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        T.lookup(rules.CATEGORY_BY_TAG, tag).alias("category"),
        F.coalesce(T.blank_to_null(F.col("tags")["name"]), fallback).alias("name"),
        T.lookup(rules.ICON_BY_TAG, tag).alias("icon"),
        "tags", *keep,
    )
    return pois if categories is None else category_filter(pois, categories)


def tag_predicates(rule_table: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
    """Wanted values per tag key: what a source has to be asked for."""
    if categories is not None:
        rule_table = rule_table.filter(F.col("category").isin(*categories))
    return rule_table.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))


def prefilter_elements(elements: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
    """Drop elements no rule of the chosen categories can match, before any join."""
    wanted = [f"{k}={v}" for c, _r, _d, k, v, _i in rules.rule_rows() if categories is None or c in set(categories)]
    return elements.filter(F.expr(f"exists(map_entries(tags), e -> {_listed('e', wanted)})"))


def category_filter(pois: DataFrame, categories: Iterable[str]) -> DataFrame:
    return pois.filter(F.col("category").isin(*categories))


def category_counts(pois: DataFrame) -> DataFrame:
    return pois.groupBy("category").agg(F.count("*").alias("n_pois"))


def sort_pois(pois: DataFrame, mode: str = "distance", collation: str | None = "UNICODE") -> DataFrame:
    """Order by ``distance``, ``category`` (then distance) or ``name``.

    ``collation`` gives accent-aware order; pass ``None`` for byte order.
    """
    return pois.orderBy(*sort_order(mode, collation))


def sort_order(mode: str = "distance", collation: str | None = "UNICODE") -> list[Column]:
    """The columns that ``sort_pois`` orders by; ties go by ``poi_id``."""
    def text_order(name: str) -> Column:
        return F.collate(F.col(name), collation) if collation else F.col(name)

    orders = {
        "distance": [F.col("distance_to_trace")],
        "category": [text_order("category"), F.col("distance_to_trace")],
        "name": [text_order("name")],
    }
    return [*orders[mode], F.col("poi_id")]


def policy(category: Column) -> Column:
    """Enrichment effort: full, minimal or skip; unknown categories are skipped."""
    return F.coalesce(T.lookup(rules.POLICY, category), F.lit("skip"))


def policy_counts(pois: DataFrame) -> DataFrame:
    p = policy(F.col("category"))
    return pois.agg(
        F.count("*").alias("n_pois"), F.count_if(p != "skip").alias("n_enrichable"),
        F.count_if(p == "full").alias("n_full"),
    )


def is_generic_name(name: Column) -> Column:
    return F.lower(T.strip(F.coalesce(name, F.lit("")))).isin(*rules.GENERIC_NAMES)


def category_label(category: Column, language: str) -> Column:
    return F.coalesce(T.lookup(rules.CATEGORY_LABEL.get(language, {"": ""}), category), category)


def name_label(name: Column, language: str) -> Column:
    if language != "fr":
        return name
    return F.coalesce(T.lookup(rules.GENERIC_NAME_FR, T.strip(F.lower(name))), name)


def osmand_icon(tags: str, category: Column) -> Column:
    """Icon of the first tag that has one, else the category's, else a star."""
    hit = first_listed_tag(tags, rules.OSMAND_TAG_ICON)
    return F.coalesce(
        T.lookup(rules.OSMAND_TAG_ICON, _tag_text(hit)), T.lookup(rules.OSMAND_ICON, category),
        F.lit(rules.OSMAND_ICON_FALLBACK),
    )


# --- Fixed values: patterns over opening-hours text ---------------------------
SUNDAY = r"\b(su|sun|sunday|dim|dimanche|do|domingo)\b"
SUNDAY_IN_RANGE = r"\b(mo|mon|lu|lun)\s*[-–]\s*(su|sun|dim|do)\b|7\s*[j/]\s*[/]?\s*7"
SUNDAY_CLOSED = r"\b(su|sun|sunday|dim|dimanche)\b[^;/\n]*\b(closed|fermé|geschlossen|cerrado)\b"
CLOSED_WORD = r"closed|fermé|geschlossen|cerrado"
TIME_RANGE = r"\d{1,2}[h:.]?\d{0,2}\s*[-–]\s*\d{1,2}[h:.]?\d{0,2}"


def hours_source(enriched: Column, osm: Column) -> Column:
    """Enrichment text wins whenever it is present, even if blank."""
    return F.coalesce(enriched, osm, F.lit(""))


def open_sunday(hours: Column) -> Column:
    raw = F.lower(hours)
    after = T.first_match(raw, rf"(?s){SUNDAY}(.{{0,30}})", 2)
    named_open = T.matches(raw, SUNDAY) & ~T.matches(F.coalesce(after, F.lit("")), CLOSED_WORD)
    return (
        (raw != "") & ~T.matches(raw, SUNDAY_CLOSED) & (T.matches(raw, SUNDAY_IN_RANGE) | named_open)
    )


def open_evening(hours: Column) -> Column:
    """Some time range ends at 20 h or later, or between 0 h and 2 h."""
    ranges = T.all_matches(hours, TIME_RANGE)

    def late(one: Column) -> Column:
        hour = T.first_match(one, r"[-–]\s*(\d{1,2})", 1).cast("int")
        return F.coalesce((hour >= 20) | (hour <= 2), F.lit(False))

    return F.exists(ranges, late)


def availability_tags(hours: Column, language: str = "en") -> Column:
    sunday, evening = {"en": ("Open Sunday", "Open evenings"), "fr": ("Ouvert le dimanche", "Ouvert le soir")}[language]
    return T.compact_array(
        F.when(open_sunday(hours), F.lit(sunday)), F.when(open_evening(hours), F.lit(evening))
    )


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.6, "high").when(confidence >= 0.3, "medium").when(confidence > 0, "low")
    )


# --- Links and official site -----------------------------------------------------


def google_maps_url(name: Column, lat: Column, lon: Column) -> Column:
    return F.concat(
        F.lit("https://www.google.com/maps/search/"), T.percent_encode(name), F.lit("/@"),
        T.number_text(lat), F.lit(","), T.number_text(lon), F.lit(",17z"),
    )


def google_directions_url(lat: Column, lon: Column) -> Column:
    return F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&destination="), T.number_text(lat), F.lit(","), T.number_text(lon)
    )


def yandex_maps_url(name: Column, lat: Column, lon: Column) -> Column:
    """Null for a blank name or coordinates out of range."""
    usable = (T.strip(name) != "") & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(
        usable,
        F.concat(
            F.lit("https://yandex.com/maps/?text="), T.percent_encode(T.strip(name)), F.lit("&ll="),
            T.number_text(lon), F.lit(","), T.number_text(lat), F.lit("&z=16"),
        ),
    )


def is_rejected_domain(url: Column) -> Column:
    """Social profiles, directories and review platforms are not official sites."""
    host = F.regexp_replace(urls.bare_host(url), r"^m\.", "")
    exact = "|".join(d.replace(".", r"\.") for d in rules.NOT_OFFICIAL_DOMAINS)
    brand = "|".join(rules.NOT_OFFICIAL_BRANDS)
    return F.coalesce(host.rlike(rf"(^|\.)({exact})$") | host.rlike(rf"^({brand})(\.|$)"), F.lit(False))


def official_site(tags: Column) -> Column:
    """First usable website tag, completed with https:// when it is a bare domain."""

    def as_url(key: str) -> Column:
        raw = T.strip(tags[key])
        url = (
            F.when(T.matches(raw, r"^https?://", True), raw)
            .when(T.matches(raw, r"^[\w.-]+\.[a-z]{2,}(/.*)?$", True), F.concat(F.lit("https://"), raw))
        )
        return F.when(~is_rejected_domain(url), url)

    return F.coalesce(*[as_url(k) for k in rules.OFFICIAL_SITE_TAGS])
