"""Enrichment cache, look-ups and work-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from . import pois as P
from .newest import first_rows

KEY = ["osm_type", "osm_id"]
# --- Fixed values: limits of the cache -----------------------------------------
MAX_AGE_DAYS, MIN_AGE, MAX_AGE = 90, 1, 365
MAX_CATEGORY, MAX_NAME, MAX_PAYLOAD = 100, 500, 200_000


def cacheable() -> Column:
    return F.col("osm_type").isin("node", "way", "relation") & (F.col("osm_id") > 0)


def is_stale(as_of: str, max_age_days: int = MAX_AGE_DAYS) -> Column:
    days = min(max(MIN_AGE, max_age_days), MAX_AGE)
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY") > F.col("enriched_at")


def lookup(requests: DataFrame, cache: DataFrame, as_of: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Cached row of each requested key, with ``is_stale``; misses are left out."""
    keys = requests.filter(cacheable()).select(*KEY).distinct()
    return cache.join(keys, KEY).withColumn("is_stale", is_stale(as_of, max_age_days))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cache_key", F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")))


def store(cache: DataFrame, name: str, buckets: int = 256) -> None:
    """The cache as a table in buckets by key, one file each, so that look-ups by key neither shuffle nor scan it whole."""
    keyed = _keyed(cache).repartition(buckets, "cache_key")
    keyed.write.bucketBy(buckets, "cache_key").sortBy("cache_key").saveAsTable(name)


def lookup_stored(requests: DataFrame, name: str, as_of: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """``lookup`` in a stored cache: only the requested keys are dealt to its buckets."""
    keys = _keyed(requests.filter(cacheable())).select("cache_key").distinct()
    stored = requests.sparkSession.table(name)
    return stored.join(keys, "cache_key").drop("cache_key").withColumn("is_stale", is_stale(as_of, max_age_days))


def lookup_keys(spark: SparkSession, name: str, keys: list[tuple[str, int]], as_of: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Cached rows of a few keys: reads their buckets alone."""
    wanted = [f"{kind}/{number}" for kind, number in keys if kind in ("node", "way", "relation") and number > 0]
    stored = spark.table(name).filter(F.col("cache_key").isin(*wanted))
    return stored.drop("cache_key").withColumn("is_stale", is_stale(as_of, max_age_days))


def lookup_stats(requests: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Requested keys (with repeats), distinct hits, and the difference."""
    asked = (
        requests.filter(cacheable()).groupBy(*KEY).agg(F.count("*").alias("n"))
        .join(cache.select(*KEY).withColumn("hit", F.lit(1)), KEY, "left")
    )
    return asked.agg(F.sum("n").alias("requested"), F.count("hit").alias("hits")).select(
        "requested", "hits", (F.col("requested") - F.col("hits")).alias("misses")
    )


def with_reuse(pois: DataFrame, cache: DataFrame, as_of: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Adds ``reuse``: whether a place has a fresh cached row. One join; every place stays once."""
    fresh = cache.filter(~is_stale(as_of, max_age_days)).select(F.col("osm_type").alias("_type"), F.col("osm_id").alias("_id"), F.lit(True).alias("reuse")).distinct()
    wanted = pois.drop("reuse").withColumn("_key", F.when(cacheable(), F.col("osm_id")))
    found = wanted.join(fresh, (F.col("osm_type") == F.col("_type")) & (F.col("_key") == F.col("_id")), "left")
    return found.drop("_key", "_type", "_id").withColumn("reuse", F.coalesce("reuse", F.lit(False)))


def split_by_cache(
    pois: DataFrame, cache: DataFrame, as_of: str, max_age_days: int = MAX_AGE_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Places whose fresh cached row is reused, and places to work on. To use both in one job, take ``with_reuse``."""
    flagged = with_reuse(pois, cache, as_of, max_age_days)
    return flagged.filter("reuse").drop("reuse"), flagged.filter("NOT reuse").drop("reuse")


def acceptable(updates: DataFrame) -> DataFrame:
    """Updates the cache takes: finished work with a sane category, place and size."""
    return updates.filter(
        cacheable() & (F.col("status") == "done")
        & F.char_length("category").between(1, MAX_CATEGORY)
        & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
        & (F.char_length("enrichment") <= MAX_PAYLOAD)
    ).withColumn("name", F.substring("name", 1, MAX_NAME))


def newest(versions: DataFrame, *tie: str) -> DataFrame:
    """Last write per key: which one is decided without payloads, see ``first_rows``."""
    return first_rows(versions, KEY, ["enriched_at", *tie], last=True)


def upsert(existing: DataFrame, updates: DataFrame, *tie: str) -> DataFrame:
    """Last write per key over the cache and its updates."""
    return newest(existing.unionByName(acceptable(updates).select(*existing.columns)), *tie)


def needs_work() -> Column:
    """No result, an error, or nothing found while some engine did not answer."""
    degraded = (
        (F.col("status") == "skipped") & (F.col("skip_reason") == "no-results")
        & (F.coalesce(F.size("unresponsive_engines"), F.lit(0)) > 0)
    )
    return F.col("status").isNull() | (F.col("status") == "error") | F.coalesce(degraded, F.lit(False))


def pending(pois: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Places that still have to be enriched."""
    state = enrichments.select("poi_id", "status", "skip_reason", "unresponsive_engines")
    return pois.join(state, "poi_id", "left").filter(needs_work()).select(pois.columns)


def geocode_key(coordinate: Column) -> Column:
    """Coordinate in thousandths of a degree (about 111 m)."""
    return F.floor(coordinate * 1000 + 0.5).cast("long")


def geocode_requests(pois: DataFrame) -> DataFrame:
    """One request per rounded coordinate."""
    return pois.select(geocode_key(F.col("lat")).alias("lat_key"), geocode_key(F.col("lon")).alias("lon_key")).distinct()


def attach_geocodes(pois: DataFrame, geocodes: DataFrame) -> DataFrame:
    keyed = pois.withColumn("lat_key", geocode_key(F.col("lat"))).withColumn("lon_key", geocode_key(F.col("lon")))
    return keyed.join(geocodes, ["lat_key", "lon_key"], "left")


def clean_name(name: Column) -> Column:
    """Name without a closing remark in brackets or behind a dash."""
    out = T.strip(F.coalesce(name, F.lit("")))
    out = T.strip(T.replace(out, r"\s*\([^)]*\)\s*$", ""))
    return T.strip(T.replace(out, r"\s*[-–]\s*(fermé|closed|temporairement|temporarily).*$", "", True))


def search_queries(pois: DataFrame) -> DataFrame:
    """Search texts per place: the full one, then name and locality; equal ones once.

    Needs ``name, category, tags, locality, county, state``.
    """
    name = clean_name(F.col("name"))
    generic = (name == "") | name.isin("Unknown", "unnamed")
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    locality, county, state = (T.blank_to_null(F.col(c)) for c in ("locality", "county", "state"))
    terms = T.compact_array(
        locality,
        F.when(~county.eqNullSafe(F.col("locality")), county),
        F.when(~state.eqNullSafe(F.col("locality")) & ~state.eqNullSafe(F.col("county")), state),
    )
    hints = F.transform(
        F.filter(F.map_entries("tags"), lambda e: e["key"].isin("amenity", "shop", "tourism", "leisure")),
        lambda e: F.replace(e["value"], F.lit("_"), F.lit(" ")),
    )
    words = F.coalesce(T.lookup(rules.SEARCH_WORDS, F.col("category")), F.lit(rules.SEARCH_WORDS_DEFAULT))
    full = F.array_join(T.compact_array(
        F.when(~generic, quoted), T.blank_to_null(F.array_join(terms, " ")),
        F.when(generic, T.blank_to_null(F.array_join(hints, " "))), words,
    ), " ")
    short = F.array_join(T.compact_array(F.when(name != "", quoted), locality), " ")
    variants = T.unique_texts(F.array(full, short))
    return pois.select("*", F.posexplode(variants).alias("variant", "query"))


def worklist(pois: DataFrame) -> DataFrame:
    """Search texts with the links a fetcher or a reader needs."""
    at = (F.col("lat"), F.col("lon"))
    return (
        search_queries(pois)
        .withColumn("google_maps_url", P.google_maps_url(F.col("name"), *at))
        .withColumn("google_directions_url", P.google_directions_url(*at))
        .withColumn("yandex_maps_url", P.yandex_maps_url(F.col("name"), *at))
        .withColumn("official_site", P.official_site(F.col("tags")))
    )
