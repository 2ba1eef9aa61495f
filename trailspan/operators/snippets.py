"""Snippet cleaning, ranking and top-k.

One place may have very many snippets, so each reduction per place is an
aggregate or a row-number limit, both of which Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions import text as T
from ..functions import urls

# --- Fixed values -----------------------------------------------------------------
MAX_SNIPPETS = 8
MAX_CANDIDATES = 16
NOISE = r"my unicredit banking|internet banking|login|sign in"
NON_LATIN = r"[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ֐-׿ऀ-ॿ]"
NON_LATIN_SHARE = 0.15
_CITY = r"([A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*)"
TITLE_CITY = [
    (rf",\s*{_CITY}\s*[-–:·]?\s*", False),
    (rf"[-–]\s*{_CITY}\s*$", False),
    (rf"in\s+{_CITY}", True),
]


def per_place(*order: Column | str):
    return W.partitionBy("poi_id").orderBy(*order)


def first_k(snippets: DataFrame, k: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per place; the rank is kept under the name given."""
    name = rank or "_rank"
    out = snippets.withColumn(name, F.row_number().over(per_place(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def dedup(snippets: DataFrame, k: int | None = MAX_CANDIDATES) -> DataFrame:
    """First snippet per place and page; blank ones dropped; first ``k`` kept.

    ``pos`` is unique within a place. Which rows stay is decided on place, page and position; texts are fetched for those alone.
    """
    usable = snippets.withColumn("content", T.strip(F.col("content"))).filter(F.col("content") != "")
    page = F.coalesce(urls.normalize(F.col("url")), F.lit(""))
    firsts = usable.select("poi_id", page.alias("_page"), "pos").groupBy("poi_id", "_page").agg(F.min("pos").alias("pos"))
    # All pages of all places: dealt by place and position, so that a place with very many is worked on by all tasks.
    firsts = firsts.hint("shuffle_hash") if k is None else first_k(firsts, k, "pos")
    return usable.join(firsts.select("poi_id", "pos"), ["poi_id", "pos"], "left_semi")


def is_noise(title: Column, content: Column, url: Column, legacy: bool = False) -> Column:
    """Banking and login pages, and texts in another script.

    ``legacy`` counts at most one foreign letter, as the first version did.
    """
    named = T.matches(title, NOISE, True) | T.matches(content, NOISE, True) | T.matches(url, NOISE, True)
    sample = F.concat(title, F.lit(" "), F.substring(content, 1, 200))
    foreign = F.regexp_count(sample, F.lit(NON_LATIN))
    foreign = F.least(foreign, F.lit(1)) if legacy else foreign
    dense = foreign / F.greatest(F.char_length(T.replace(sample, r"\s", "")), F.lit(1)) > NON_LATIN_SHARE
    return named | dense


def is_elsewhere(title: Column, content: Column, locality: Column, county: Column, state: Column, country: Column) -> Column:
    """The title names another town and the text none of the expected places."""
    text = F.lower(F.concat(title, F.lit(" "), content))
    wanted = [T.blank_to_null(F.lower(c)) for c in (locality, county, state, country)]
    place, wanted_county, _state, wanted_country = wanted
    mentioned = F.lit(False)
    for w in wanted:
        mentioned = mentioned | F.coalesce(text.contains(w), F.lit(False))
    verdict = F.lit(False)
    # The patterns are tried in order and the first that decides wins, so the
    # decision is built from the last one backwards.
    for source, ignore_case in reversed(TITLE_CITY):
        city = F.lower(T.first_match(title, source, 1, ignore_case))
        decides_here = (F.char_length(city) >= 3)
        same = (city == place) | F.coalesce(city == wanted_county, F.lit(False)) | F.coalesce(city == wanted_country, F.lit(False))
        other = ~place.contains(city) & ~city.contains(place)
        verdict = (
            F.when(F.coalesce(decides_here & same, F.lit(False)), F.lit(False))
            .when(F.coalesce(decides_here & other, F.lit(False)), F.lit(True))
            .otherwise(verdict)
        )
    return ~mentioned & verdict


def clean(snippets: DataFrame, context: DataFrame, k: int = MAX_SNIPPETS, candidates: int | None = MAX_CANDIDATES) -> DataFrame:
    """First ``k`` snippets per place that are neither noise nor about elsewhere.

    ``context`` has one row per place: ``poi_id, locality, county, state, country``.
    Only the first ``candidates`` pages of a place are looked at (all if None).
    """
    kept = dedup(snippets, candidates).filter(~is_noise(F.col("title"), F.col("content"), F.col("url")))
    places = ("locality", "county", "state", "country")
    joined = kept.join(context.select("poi_id", *places), "poi_id", "left")
    here = joined.filter(~is_elsewhere(F.col("title"), F.col("content"), *[F.col(p) for p in places]))
    return first_k(here.drop(*places), k, "pos")


def first_pages(snippets: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """The rows of ``dedup`` in one scan: both limits run before their shuffles, which carry the texts of what is left."""
    usable = snippets.withColumn("content", T.strip(F.col("content"))).filter(F.col("content") != "").withColumn("_page", urls.normalize(F.col("url")))
    one = F.row_number().over(W.partitionBy("poi_id", "_page").orderBy("pos"))
    return first_k(usable.withColumn("_n", one).filter("_n = 1").drop("_n", "_page"), k, "pos")


def clean_hits(hits: Column, place: Column, k: int = MAX_SNIPPETS) -> Column:
    """``clean`` on the gathered candidates of one place."""
    kept = F.filter(hits, lambda h: ~is_noise(h["title"], h["content"], h["url"]))
    here = F.filter(kept, lambda h: ~is_elsewhere(h["title"], h["content"], *[place[p] for p in ("locality", "county", "state", "country")]))
    return F.slice(here, 1, k)


def united_hits(own: Column, hits: Column, maps: Column, unresponsive: Column, k: int = MAX_SNIPPETS) -> Column:
    """``union_sources`` on the gathered rows of one place."""
    plain = lambda rows: F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in ("title", "url", "content", "engine")]))
    none = F.expr("cast(array() as array<struct<title:string,url:string,content:string,engine:string>>)")
    two = F.slice(F.concat(F.coalesce(plain(own), none), F.coalesce(plain(hits), none)), 1, k)
    wanted = (F.size(two) < 2) | (F.coalesce(unresponsive, F.lit(0)) >= 2)
    return F.when(wanted, F.slice(F.concat(two, F.coalesce(plain(maps), none)), 1, k)).otherwise(two)


def ranked_hits(united: Column) -> Column:
    """``rank_by_quality`` on the gathered rows of one place, with ``pos`` from 0."""
    scored = F.transform(united, lambda r, i: F.struct(
        (-domain_quality(r["url"])).alias("score"), (-F.char_length(r["content"])).alias("size"), i.alias("at"), r.alias("r")))
    best = F.sort_array(F.filter(scored, lambda s: s["score"] < 0))
    return F.transform(best, lambda s, i: F.struct(i.cast("long").alias("pos"), *[s["r"][c].alias(c) for c in ("title", "url", "content", "engine")]))


def website_rows() -> Column:
    """Up to three snippets of a website preview as an array: description, hours, facts."""
    s = F.col("structured")
    url = F.coalesce(T.blank_to_null(F.col("final_url")), F.col("url"))
    facts = F.array_join(T.compact_array(
        F.when(s["rating"].isNotNull(), F.concat(F.lit("Rating "), T.number_text(s["rating"]), F.lit("/5"))),
        F.when(s["reviewCount"].isNotNull(), F.concat(T.number_text(s["reviewCount"]), F.lit(" reviews"))),
        F.when(T.blank_to_null(s["priceRange"]).isNotNull(), F.concat(F.lit("Price "), s["priceRange"])),
    ), ". ")
    hours = F.when(F.size(s["openingHours"]) > 0, F.concat(F.lit("Opening hours: "), F.array_join(s["openingHours"], "; ")))
    return _rows(url, "official_website", (F.coalesce(F.col("title"), F.lit("Official site")), T.blank_to_null(s["description"])),
                 (F.lit("Official opening hours"), hours), (F.lit("Official structured data"), T.blank_to_null(facts)))


def _rows(url: Column, engine: str, *found: tuple[Column, Column]) -> Column:
    """Snippets with a content, each with its place in the list."""
    rows = [F.struct(F.lit(k).alias("pos"), title.alias("title"), url.alias("url"), content.alias("content"), F.lit(engine).alias("engine")) for k, (title, content) in enumerate(found)]
    return F.filter(F.array(*rows), lambda r: r["content"].isNotNull())


def website_snippets(previews: DataFrame) -> DataFrame:
    """Up to three snippets from a website preview, a row each."""
    return previews.select("poi_id", F.inline(website_rows()))


def flatten_hours(hours: Column) -> Column:
    """``[{day, open, close}]`` as ``Mon: 08:00-18:00; Sun: closed``."""
    return F.array_join(F.transform(
        hours,
        lambda h: F.concat(
            h["day"], F.lit(": "),
            F.when(F.lower(h["open"]) == "closed", F.lit("closed"))
            .when(T.blank_to_null(h["close"]).isNotNull(), F.concat_ws("-", h["open"], h["close"]))
            .otherwise(h["open"]),
        ),
    ), "; ")


def map_rows() -> Column:
    """Up to two snippets of a map preview as an array: its text and its facts."""
    hours = F.when(F.size("structured_hours") > 0, flatten_hours(F.col("structured_hours"))).otherwise(F.col("hours_text"))
    facts = F.array_join(F.filter(F.array(
        F.col("category"),
        F.concat(F.lit("Rating "), T.number_text(F.col("rating")), F.lit("/5")),
        F.concat(F.col("review_count").cast("string"), F.lit(" reviews")),
        F.concat(F.lit("Price "), F.repeat(F.lit("$"), F.col("price_level"))),
        hours, F.col("address"), F.col("phone"),
    ), lambda x: x.isNotNull() & (x != "")), ". ")
    title = F.coalesce(F.col("title"), F.lit("Google Maps"))
    url = F.coalesce(T.blank_to_null(F.col("resolved_url")), F.col("url"))
    return _rows(url, "google_maps", (title, T.blank_to_null(F.col("snippet"))), (F.concat(title, F.lit(" facts")), T.blank_to_null(facts)))


def map_snippets(previews: DataFrame) -> DataFrame:
    """Up to two snippets from a map preview, a row each."""
    return previews.select("poi_id", F.inline(map_rows()))


def preview_fields() -> Column:
    """Names of the map-preview fields that are present, in fixed order."""
    text = lambda c: T.blank_to_null(F.col(c)).isNotNull()
    return T.compact_array(
        F.when((F.size("structured_hours") > 0) | text("hours_text"), F.lit("openingHours")),
        F.when(F.col("rating").isNotNull(), F.lit("rating")),
        F.when(F.col("review_count").isNotNull(), F.lit("reviewCount")),
        F.when(text("address"), F.lit("address")), F.when(text("phone"), F.lit("phone")),
        F.when(text("website"), F.lit("website")),
        F.when(F.col("price_level").isNotNull(), F.lit("priceLevel")),
        F.when(text("category"), F.lit("category")),
    )


def union_sources(search: DataFrame, website: DataFrame, maps: DataFrame, engines_down: DataFrame, k: int = MAX_SNIPPETS) -> DataFrame:
    """Website snippets, then search snippets, cut to ``k``; then map snippets for the
    places with fewer than two so far or at least two silent engines, cut again.

    ``engines_down`` has ``poi_id, n_unresponsive``. ``pos`` is renumbered from 0.
    """
    columns = ["poi_id", "pos", "title", "url", "content", "engine"]
    tagged = lambda df, rank: df.select(*columns, F.lit(rank).alias("source_rank"))
    own = first_k(tagged(website, 0).unionByName(tagged(search, 1)), k, "source_rank", "pos")
    # Each source is already short per place, so counting is cheap.
    so_far = own.groupBy("poi_id").agg(F.count("*").alias("n"))
    wanted = (
        tagged(maps, 2).join(so_far, "poi_id", "left").join(engines_down.select("poi_id", "n_unresponsive"), "poi_id", "left")
        .filter((F.coalesce("n", F.lit(0)) < 2) | (F.coalesce("n_unresponsive", F.lit(0)) >= 2))
        .drop("n", "n_unresponsive")
    )
    out = first_k(own.unionByName(wanted), k, "source_rank", "pos", rank="_rank")
    return out.withColumn("pos", (F.col("_rank") - 1).cast("long")).drop("_rank", "source_rank")


def domain_quality(url: Column) -> Column:
    lower = F.lower(url)
    (source, score), *more = rules.DOMAIN_QUALITY
    ladder = F.when(lower.rlike(source), score)
    for source, score in more:
        ladder = ladder.when(lower.rlike(source), score)
    return ladder.otherwise(1)


def rank_by_quality(snippets: DataFrame) -> DataFrame:
    """Drop noise domains; best domains first, longer texts first. ``pos`` is renumbered."""
    scored = snippets.withColumn("score", domain_quality(F.col("url"))).filter("score > 0")
    order = per_place(F.desc("score"), F.desc(F.char_length("content")), "pos")
    return scored.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def platform(url: Column) -> Column:
    host = urls.host(url)
    (part, name), *more = rules.PLATFORM_BY_HOST
    ladder = F.when(host.contains(part), name)
    for part, name in more:
        ladder = ladder.when(host.contains(part), name)
    return ladder.otherwise("other")


def is_official(url: Column, official_url: Column) -> Column:
    """The snippet's host is the official host or below it."""
    own, site = urls.bare_host(url), urls.bare_host(official_url)
    return F.coalesce((own == site) | own.endswith(F.concat(F.lit("."), site)), F.lit(False))


def engines_seen(snippets: DataFrame) -> DataFrame:
    """Distinct engines per place in first-seen order.

    Reduced to one row per (place, engine) before engines are listed.
    """
    first = snippets.groupBy("poi_id", "engine").agg(F.min("pos").alias("pos"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "engine"))), lambda s: s["engine"])
    return first.groupBy("poi_id").agg(listed.alias("engines"))
