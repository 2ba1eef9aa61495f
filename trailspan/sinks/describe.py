"""Texts about a place: compact lines for GPS devices and HTML.

Place columns: ``name, category, icon, lat, lon, tags, distance_to_trace,
along_trace_distance``. The enrichment, if any, is the struct ``e``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.extract import hours_lines
from ..operators.pois import availability_tags, hours_source

# --- Fixed values: lengths and day abbreviations ------------------------------------
MAX_CHARS, TEXT_LINE, HOURS_LINE, CAUTION_LINE = 400, 150, 90, 80
SHORT_DAY = {
    "monday": "Mo", "tuesday": "Tu", "wednesday": "We", "thursday": "Th", "friday": "Fr", "saturday": "Sa", "sunday": "Su",
    "mon": "Mo", "tue": "Tu", "wed": "We", "thu": "Th", "fri": "Fr", "sat": "Sa", "sun": "Su",
}


def _e(name: str) -> Column:
    return F.col("e")[name]


def is_done() -> Column:
    return F.coalesce(_e("status") == "done", F.lit(False))


def _tag(*names: str) -> Column:
    return F.coalesce(*[F.col("tags")[n] for n in names])


def short_days(days: Column) -> Column:
    """Day names inside a text by their two-letter forms."""
    out = days
    for word, short in SHORT_DAY.items():
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z]){word}(?![A-Za-z])", short)
    return out


def _short_time(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\b0(\d):", "$1:"), r":00\b", "")


def compact_hours(hours: Column) -> Column:
    """``Mo-Fr 8-18 · Su closed`` from opening-hours rows."""
    return F.array_join(F.transform(hours, lambda h: F.concat(
        short_days(h["day"]),
        F.when((h["open"] == "closed") | (F.coalesce(h["close"], F.lit("")) == ""), F.lit(" closed"))
        .otherwise(F.concat(F.lit(" "), _short_time(h["open"]), F.lit("-"), _short_time(h["close"]))),
    )), " · ")


def compact_raw_hours(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, T.pattern(r"[;\n]|\s/\s")), T.strip), lambda p: p != "")
    return T.truncate_words(F.array_join(parts, " · "), HOURS_LINE)


def position_text() -> Column:
    return F.concat(
        F.lit("km "), T.one_decimal(F.col("along_trace_distance") / 1000), F.lit(" — "),
        T.js_round(F.col("distance_to_trace")).cast("string"), F.lit("m"),
    )


def compact_description() -> Column:
    """Up to five lines and 400 characters; whole lines are dropped from the end."""
    done = is_done()
    stars = F.concat(F.lit("★"), T.one_decimal(_e("rating")))
    header = F.array_join(T.compact_array(
        F.col("category"),
        F.when(done & _e("rating").isNotNull(), F.concat(stars, F.coalesce(F.concat(F.lit(" ("), _e("review_count").cast("string"), F.lit(")")), F.lit("")))),
        F.when(done & (_e("price_level") > 0), F.repeat(F.lit("$"), F.least(_e("price_level"), F.lit(4)))),
        position_text(),
    ), " · ")
    about = F.when(done & (_e("description") != ""), T.truncate_words(_e("description"), TEXT_LINE))
    hours = (
        F.when(done & (F.size(_e("opening_hours")) > 0), compact_hours(_e("opening_hours")))
        .when(done & (_e("hours") != ""), compact_raw_hours(_e("hours")))
        .when(_tag("opening_hours") != "", compact_raw_hours(_tag("opening_hours")))
    )
    phone, site = _tag("phone", "contact:phone"), _tag("website", "contact:website")
    contact = F.when(phone != "", F.concat(F.lit("☎ "), phone)).when(site != "", site)
    caution = F.get(_e("structured")["cautions"], F.lit(0))
    lines = T.compact_array(
        header, about, F.when(hours != "", T.truncate_words(hours, HOURS_LINE)), contact,
        F.when(caution != "", F.concat(F.lit("⚠ "), T.truncate_words(caution, CAUTION_LINE))),
    )
    def fit(ls: Column) -> Column:
        # The longest run of first lines that fits; the first line is always kept.
        runs = F.transform(F.sequence(F.size(ls), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(ls, F.lit(1), n), "\n"))
        kept = F.filter(runs, lambda text: F.char_length(text) <= MAX_CHARS)
        return F.coalesce(F.get(kept, F.lit(0)), T.truncate_words(ls[0], MAX_CHARS))

    return T.let(lines, fit)


def _hours_html(raw: Column) -> Column:
    return F.replace(T.escape_xml(hours_lines(raw)), F.lit("\n"), F.lit("<br/>"))


def html_description() -> Column:
    """All that is known about a place as labelled HTML parts."""
    done = is_done()
    e = _e
    s = _e("structured")
    whole = T.js_round(e("rating")).cast("int")
    rating = F.concat(
        F.lit("<b>Rating:</b> "), F.repeat(F.lit("★"), whole), F.repeat(F.lit("☆"), 5 - whole), F.lit(" "),
        T.one_decimal(e("rating")), F.lit("/5"),
        F.coalesce(F.concat(F.lit(" ("), e("review_count").cast("string"), F.lit(" reviews)")), F.lit("")),
    )

    def text(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), T.escape_xml(value)))

    def listed(label: str, values: Column, joiner: str) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), T.escape_xml(F.array_join(values, joiner))))

    digests = F.when(done, F.transform(
        s["source_rollup"],
        lambda d: F.concat(F.lit("<b>Source - "), T.escape_xml(d["platform"]), F.lit(":</b> "), T.escape_xml(d["brief"])),
    ))
    reason = F.coalesce(F.concat(F.lit(" ("), T.escape_xml(T.blank_to_null(e("synthesis_reason"))), F.lit(")")), F.lit(""))
    first = T.compact_array(
        F.concat(F.lit("<b>Category:</b> "), F.col("category")),
        F.when(done, rating),
        F.when(done, F.concat(F.lit("<b>Price:</b> "), F.repeat(F.lit("$"), e("price_level")))),
        F.when(done & (e("hours") != ""), F.concat(F.lit("<b>Hours:</b><br/>"), _hours_html(e("hours")))),
        F.when(done & (e("description") != ""), F.concat(F.lit("<i>"), T.escape_xml(e("description")), F.lit("</i>"))),
        F.when(done, text("", e("review"))),
        F.when(done, listed("<b>Cautions:</b> ", s["cautions"], " ")),
        F.when(done, listed("<b>Divergences:</b> ", s["divergences"], " ")),
    )
    site = _tag("website")
    safe = F.when(T.matches(site, r"^https?://", True), T.escape_xml(site)).otherwise(F.lit("#"))
    available = availability_tags(hours_source(e("hours"), _tag("opening_hours")))
    last = T.compact_array(
        F.when(done, text("<b>Location:</b> ", e("locality"))),
        F.when(done & (e("source_count") > 0), F.concat(F.lit("<b>Sources:</b> "), e("source_count").cast("string"))),
        F.when(done & (e("confidence") > 0), F.concat(F.lit("<b>Confidence:</b> "), T.js_round(e("confidence") * 100).cast("string"), F.lit("%"))),
        F.when(done & e("synthesis_source").isNotNull(), F.concat(F.lit("<b>Synthesis:</b> "), T.escape_xml(e("synthesis_source")), reason)),
        F.when(done, listed("<b>Google Maps fields:</b> ", e("google_maps_fields"), ", ")),
        F.when(done & (e("google_maps_url") != ""), F.concat(F.lit('<a href="'), T.escape_xml(e("google_maps_url")), F.lit('">Google Maps</a>'))),
        F.when(~done, text("<b>Hours:</b> ", _tag("opening_hours"))),
        text("<b>Phone:</b> ", _tag("phone")),
        F.when(site != "", F.concat(F.lit('<b>Web:</b> <a href="'), safe, F.lit('">'), T.escape_xml(site), F.lit("</a>"))),
        text("<b>Fee:</b> ", _tag("fee")),
        F.when(F.size(available) > 0, F.concat(F.lit('<b style="color:#16a34a">'), F.array_join(available, " · "), F.lit("</b>"))),
        F.concat(
            F.lit("<b>km "), T.one_decimal(F.col("along_trace_distance") / 1000), F.lit("</b> — "),
            T.js_round(F.col("distance_to_trace")).cast("string"), F.lit("m from route"),
        ),
    )
    return F.array_join(F.concat(first, F.coalesce(digests, F.array().cast("array<string>")), last), "<br/>")
