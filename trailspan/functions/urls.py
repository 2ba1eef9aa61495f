"""URL parts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "fbclid", "gclid", "ref", "source", "srsltid",
]


def host(url: Column) -> Column:
    """Lower-case host name; null when the text is not an absolute URL."""
    return F.nullif(F.lower(F.regexp_extract(url, _URL, 2)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize(url: Column) -> Column:
    """One spelling per page: tracking parameters, ``www.``/``m.`` and a trailing
    slash are dropped. Text that is not an absolute URL stays as it is."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    path = F.when(part(4) == "", F.lit("/")).otherwise(part(4))
    path = F.when(F.char_length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.filter(
        F.split(F.substring(part(5), 2, 1 << 30), "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING_PARAMS),
    )
    pairs = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    rebuilt = F.concat(
        F.lower(part(1)), F.lit("://"), F.regexp_replace(F.lower(part(2)), r"^(www|m)\.", ""),
        part(3), path, query, F.when(part(6) == "#", F.lit("")).otherwise(part(6)),
    )
    return F.when(url.rlike(_URL), rebuilt).otherwise(url)
