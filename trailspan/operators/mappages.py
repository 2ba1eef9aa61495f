"""Fields of map-page texts (``source, url, title, body_text``).

Both map sources run through one job; the ``source`` column picks the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions import text as T

# --- Fixed values: patterns and windows -----------------------------------------------
WINDOW_CHARS, HEAD_CHARS = 900, 800
YANDEX_RATING_CHARS, YANDEX_COUNT_CHARS = 800, 1200
SIMILAR_PLACES = r"Hôtels similaires|Nearby hotels?|Similar places|À proximité|Nearby places"
SIMILAR_HOTELS = r"Hôtels similaires|Nearby hotels|À proximité"
GOOGLE_COUNT_BRACKETS = r"\((\d[\d\s., ]*)\)"
GOOGLE_COUNT_WORDS = r"(\d[\d\s., ]*)\s+(?:reviews?|avis)"
YANDEX_COUNT = (
    r"(\d[\d\s.,]*)\s+(?:reviews?|оценок|оценки|оценка|отзывов|отзыва|отзыв|değerlendirme|yorum|avis)"
)
_SECTIONS = r"(?:Présentation|Overview|Prix|About|À propos|Directions|Itinéraires)"
GOOGLE_CATEGORY_STAR = r"\(\d[\d\s., ]*\)\s*·\s*([^·]{3,60})\s*·"
GOOGLE_CATEGORY_1 = rf"\d(?:[.,]\d)\s*(?:\(([\d\s., ]+)\))?\s*([^·]{{3,60}}?)(?:·\s*)?{_SECTIONS}"
GOOGLE_CATEGORY_2 = rf"\d(?:[.,]\d)\s+([^·]{{3,60}}?){_SECTIONS}"
YANDEX_CATEGORY = r"^([^·\n]{3,60})\s*·\s*[\d.,]"
PHONE = r"\+?\d[\d\s().-]{6,}"
ADDRESS = r"\b\d{4,5}[^\n]{10,120}"
PRICE_SYMBOLS = r"([$€£])\1{0,3}"
CAPTCHA_URL = r"showcaptcha|smartcaptcha"
CAPTCHA_PHRASES = ["are you a robot", "captcha"]
CAPTCHA_RUSSIAN = ("подтвердите", r"подтвердите.+не робот")
HOURS_HINT = {
    "google": r"(open|closed|ouvre|fermé|ferme|\d{1,2}[:h]\d{2})",
    "yandex": r"(open|closed|открыто|закрыто|круглосуточно|\d{1,2}[:h]\d{2})",
}


def _is_yandex() -> Column:
    return F.col("source") == "yandex"


def local_window(body: Column, title: Column) -> Column:
    """Text from the title on; the head of the page when the title is not in it."""
    wanted = F.lower(T.strip(T.replace(title, r"\s*-\s*Google Maps$", "", True)))
    at = F.position(wanted, F.lower(body))
    return F.when(title.isNull() | (title == "") | (at == 0), F.substring(body, 1, HEAD_CHARS)).otherwise(
        F.substr(body, at, F.lit(WINDOW_CHARS))
    )


def _before(text: Column, stop: str) -> Column:
    return F.element_at(F.split(text, T.pattern(stop, True), 2), 1)


def _count(raw: Column) -> Column:
    return T.replace(raw, r"[\s.,]", "").try_cast("long")


def rating(local: Column) -> Column:
    g = F.replace(T.first_match(_before(local, SIMILAR_PLACES), r"\b(\d(?:[.,]\d))\b", 1), F.lit(","), F.lit("."))
    y = F.replace(
        T.first_match(F.substring(local, 1, YANDEX_RATING_CHARS), r"\b([1-5][.,]\d)\b", 1), F.lit(","), F.lit(".")
    )
    value = F.when(_is_yandex(), y).otherwise(g).try_cast("double")
    return F.when(value.between(1, 5), value)


def review_count(local: Column) -> Column:
    first = _before(local, SIMILAR_HOTELS)
    g = F.coalesce(T.first_match(first, GOOGLE_COUNT_BRACKETS, 1), T.first_match(first, GOOGLE_COUNT_WORDS, 1, True))
    y = T.first_match(F.substring(local, 1, YANDEX_COUNT_CHARS), YANDEX_COUNT, 1, True)
    return _count(F.when(_is_yandex(), y).otherwise(g))


def category(local: Column) -> Column:
    g = F.coalesce(
        T.first_match(local, GOOGLE_CATEGORY_STAR, 1, True), T.first_match(local, GOOGLE_CATEGORY_1, 2, True),
        T.first_match(local, GOOGLE_CATEGORY_2, 1, True),
    )
    found = F.when(_is_yandex(), T.first_match(local, YANDEX_CATEGORY, 1)).otherwise(g)
    return T.blank_to_null(T.collapse(found))


def phone(body: Column) -> Column:
    raw = T.collapse(T.first_match(body, PHONE))
    return T.blank_to_null(T.strip(F.regexp_replace(raw, "^[^+0-9]+", "")))


def price_level(body: Column) -> Column:
    """Length of the first run of one currency symbol; a map page of the second source has none."""
    return F.when(~_is_yandex(), F.char_length(T.first_match(body, PRICE_SYMBOLS)))


def clean_hours(raw: Column) -> Column:
    """Collapsed hours text when it reads like hours."""
    value = T.collapse(raw)
    hint = F.when(_is_yandex(), T.matches(value, HOURS_HINT["yandex"], True)).otherwise(T.matches(value, HOURS_HINT["google"], True))
    return F.when((F.char_length(value) >= 4) & hint, value)


def is_captcha(url: Column, body: Column) -> Column:
    """Plain substring tests first: a pattern runs only on the few pages that may match."""
    lower = F.lower(body)
    word, phrase = CAPTCHA_RUSSIAN
    said = lower.contains(word) & T.matches(lower, phrase)
    for plain in CAPTCHA_PHRASES:
        said = said | lower.contains(plain)
    return T.matches(url, CAPTCHA_URL, True) | F.coalesce(said, F.lit(False))


def map_fields(pages: DataFrame) -> DataFrame:
    """Rating, review count, category, phone, address, price level per page, and ``hours`` if the pages have ``hours_text``."""
    body = F.col("body_text")
    hours = [clean_hours(F.col("hours_text")).alias("hours")] if "hours_text" in pages.columns else []
    local = F.col("_local")
    return (
        pages.withColumn("_local", local_window(body, F.col("title")))
        .select(
            *pages.columns, rating(local).alias("rating"), review_count(local).alias("review_count"),
            category(local).alias("category"), phone(body).alias("phone"),
            F.when(~_is_yandex(), T.blank_to_null(T.collapse(T.first_match(body, ADDRESS)))).alias("address"),
            price_level(body).alias("price_level"), is_captcha(F.col("url"), body).alias("is_captcha"), *hours,
        )
    )


_TWELVE = r"^(\d{1,2}):(\d{2})\s*(AM|PM)$"


def _is_clock(value: Column) -> Column:
    plain = F.when(F.col("source") == "yandex", value.rlike("(?i)" + rules.MAP_SOURCES["yandex"]["clock"])).otherwise(
        value.rlike("(?i)" + rules.MAP_SOURCES["google"]["clock"])
    )
    hour = F.regexp_extract(value, r"^\d+", 0).try_cast("int")
    minute = F.substring(value, -2, 2).try_cast("int")
    return plain & (hour <= 23) & (minute <= 59)


def _clock(value: Column) -> Column:
    """Time as HH:MM; null when it is none. The second source also writes 9.30."""
    hour = F.regexp_extract(value, r"^\d+", 0)
    noon = F.upper(F.substring(value, -2, 2))
    h12 = hour.try_cast("int")
    h24 = F.when((noon == "AM") & (h12 == 12), 0).when((noon == "PM") & (h12 != 12), h12 + 12).otherwise(h12)
    return F.when(_is_clock(value), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.substring(value, -2, 2))).when(
        T.matches(value, _TWELVE, True),
        F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), T.first_match(value, r":(\d{2})", 1)),
    )


def _by_source(test) -> Column:
    return F.when(F.col("source") == "yandex", test("yandex")).otherwise(test("google"))


def with_hours_row(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``row``: ``{day, open, close}`` of a line such as "Monday 9 AM - 6 PM".

    Null when the line is none. Needs ``source``. Steps are columns of their own, so
    each pattern runs once per line.
    """
    days = _by_source(lambda s: T.lookup(rules.MAP_SOURCES[s]["days"], F.lower("_word")))
    closed = _by_source(lambda s: F.lower("_times").isin(*rules.MAP_SOURCES[s]["closed"]))
    all_day = _by_source(lambda s: T.matches(F.col("_times"), rules.MAP_SOURCES[s]["all_day"], True))
    split = (
        lines.withColumn("_text", T.collapse(F.col(line)))
        .withColumn("_word", T.blank_to_null(F.regexp_extract("_text", r"^(\S+) ", 1)))
        .withColumn("_times", F.regexp_extract("_text", r"^\S+ (.*)$", 1))
        .withColumn("_parts", F.split("_times", r"\s*[–—\-]\s*"))
    )
    read = (
        split.withColumn("_open", T.strip(F.col("_parts")[0])).withColumn("_close", T.strip(F.element_at("_parts", -1)))
        .withColumn("_day", F.coalesce(days, F.col("_word")))
        .withColumn("_from", _clock(F.col("_open"))).withColumn("_to", _clock(F.col("_close")))
        .withColumn("_all_day", all_day).withColumn("_closed", closed)
    )
    ranged = (F.size("_parts") >= 2) & F.col("_from").isNotNull() & F.col("_to").isNotNull()

    def row(o: Column, c: Column) -> Column:
        return F.struct(F.col("_day").alias("day"), o.alias("open"), c.alias("close"))

    whole_day = row(F.lit("00:00"), F.lit("23:59"))
    # The second source lets "24h" win over a range, the first one the range.
    first_whole_day = F.col("_all_day") & (F.col("source") == "yandex")
    stated = (
        F.when(F.col("_closed"), row(F.lit("closed"), F.lit(None).cast("string"))).when(first_whole_day, whole_day)
        .when(ranged, row(F.col("_from"), F.col("_to"))).when(F.col("_all_day"), whole_day)
    )
    return read.withColumn("row", F.when(F.col("_word").isNotNull(), stated)).drop(
        "_text", "_word", "_times", "_parts", "_open", "_close", "_day", "_from", "_to", "_all_day", "_closed"
    )


def _starts_with_day() -> Column:
    return _by_source(lambda s: T.matches(F.col("line"), rf"^({'|'.join(rules.MAP_SOURCES[s]['block_days'])})\s+.+", True))


def hours_rows(pages: DataFrame) -> DataFrame:
    """The opening-hours lines of each page: ``line_no, day, open, close``.

    Lines that do not start with a day name are dropped before any further pattern
    runs; ``line_no`` counts the non-blank lines of the page.
    """
    lines = F.filter(F.transform(F.split("body_text", "\n"), T.strip), lambda x: x != "")
    key = [c for c in ("source", "url", "_page") if c in pages.columns]
    named = pages.select(*key, F.posexplode(lines).alias("line_no", "line")).filter(_starts_with_day())
    # Exploding drops the lines without hours; a filter on the row would be pushed
    # down and run all of its patterns twice.
    return with_hours_row(named).select(*key, "line_no", F.inline(F.array_compact(F.array("row"))))


def hours_blocks(pages: DataFrame, max_gap: int = 2) -> DataFrame:
    """The first block of opening-hours lines of each page, one row per entry.

    A block ends after more than two lines in a row without hours; a block of one
    entry is none. Only lines with hours take part in the window: the distance to
    the hit before shows whether the block had ended.
    """
    # Every row of pages is a page of its own, also where one URL was fetched twice.
    hits = hours_rows(pages.withColumn("_page", F.monotonically_increasing_id()))
    w = W.partitionBy("_page").orderBy("line_no")
    broken = F.coalesce(F.col("line_no") - F.lag("line_no").over(w) - 1 > max_gap, F.lit(False)).cast("int")
    first = (
        hits.withColumn("_broken", broken).withColumn("_block", F.sum("_broken").over(w)).filter("_block = 0")
        .withColumn("_n", F.count("*").over(W.partitionBy("_page"))).filter("_n >= 2")
    )
    return first.select("source", "url", "line_no", "day", "open", "close")
