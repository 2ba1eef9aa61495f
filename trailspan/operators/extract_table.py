"""Fields of every place from a whole table of snippets, however many a place has.

The same readings as in ``extract``, which works on a short list per place. Here each snippet
is read where it is; what a place keeps are first values, minima, maxima and counts, which Spark
combines before the shuffle. No array of a place's texts is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions import text as T
from . import extract as X

_SYMBOL_SIZES = (2, 3, 4)


def _first(value: Column, order: Column | str = "pos") -> Column:
    """The value of the first row that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order) if isinstance(order, str) else order))


def ratings(snippets: DataFrame) -> DataFrame:
    """poi_id, rating: the first rating between 1 and 5, to one decimal."""
    values = F.filter(F.transform(T.all_matches(F.col("content"), X.RATING, 1, True), X._decimal), lambda v: v.between(1, 5))
    rows = snippets.select("poi_id", "pos", F.get(values, F.lit(0)).alias("v"))
    return rows.groupBy("poi_id").agg(T.round_to(_first(F.col("v")), 1).alias("rating"))


def review_counts(snippets: DataFrame) -> DataFrame:
    """poi_id, review_count: the first count named."""
    rows = snippets.select("poi_id", "pos", F.get(T.all_matches(F.col("content"), X.REVIEWS, 1, True), F.lit(0)).alias("v"))
    return rows.groupBy("poi_id").agg(_first(F.col("v")).try_cast("long").alias("review_count"))


def hours_texts(snippets: DataFrame) -> DataFrame:
    """poi_id, hours: the first text that reads like opening hours."""
    rows = snippets.select("poi_id", "pos", T.first_match(F.col("content"), X.HOURS_TEXT, 1, True).alias("v"))
    return rows.groupBy("poi_id").agg(T.strip(_first(F.col("v"))).alias("hours"))


def hours_tables(snippets: DataFrame) -> DataFrame:
    """poi_id, hours (array by day): the first statement on each day; null below two days."""
    one = F.array(F.struct("pos", "title", "content"))
    rows = snippets.select("poi_id", "pos", X.day_statements(one).alias("entries"))

    def of_day(day: str) -> Column:
        words = [w for w, d in rules.SNIPPET_DAYS.items() if d == day]
        return F.get(F.filter("entries", lambda e: e["word"].isin(*words)), F.lit(0))

    days = rows.select("poi_id", "pos", *(of_day(d).alias(f"d{k}") for k, d in enumerate(rules.WEEK)))
    firsts = days.groupBy("poi_id").agg(*(_first(F.col(f"d{k}")).alias(f"d{k}") for k in range(len(rules.WEEK))))
    week = F.array_compact(F.array(*(
        F.when(F.col(f"d{k}").isNotNull(), F.struct(F.lit(d).alias("day"), F.col(f"d{k}.open").alias("open"), F.col(f"d{k}.close").alias("close")))
        for k, d in enumerate(rules.WEEK)
    )))
    return firsts.select("poi_id", week.alias("week")).select("poi_id", F.when(F.size("week") >= 2, F.col("week")).alias("hours"))


def price_levels(snippets: DataFrame, places: DataFrame, legacy: bool = False) -> DataFrame:
    """poi_id, price_level; ``places`` has poi_id and category. A phrase is looked for within each snippet."""
    c = F.col("content")
    sizes = F.transform(T.all_matches(c, X.REPEATED_SYMBOL, 0, True), lambda m: F.char_length(T.replace(m, r"\s", "")))
    said = c if legacy else T.replace(c, X.NOT_CHEAP, " cheap ", True)
    prices = F.filter(
        F.transform(T.all_matches(c, X.PRICE, 0, True), lambda m: X._decimal(T.replace(m, r"[€$£¥\s]", ""))), lambda v: (v > 0) & (v < 10000),
    )
    # Columns of their own: what several others use is worked out once per snippet.
    read = snippets.select("poi_id", sizes.alias("_sizes"), said.alias("_said"), prices.alias("prices"))
    of_size = lambda n: F.size(F.filter("_sizes", lambda v: v == n))
    rows = read.select(
        "poi_id", *(of_size(n).alias(f"s{n}") for n in _SYMBOL_SIZES),
        *(T.matches(F.col("_said"), source, True).alias(f"w{level}") for level, source in X.PRICE_WORDS), "prices",
    )
    # A row for each price; what a snippet says besides goes with its first row, so each text is read once.
    sums, flags = [f"s{n}" for n in _SYMBOL_SIZES], [f"w{level}" for level, _ in X.PRICE_WORDS]
    tagged = rows.select("poi_id", *sums, *flags, F.posexplode_outer("prices").alias("i", "v"))
    once = F.coalesce(F.col("i"), F.lit(0)) == 0
    by_value = tagged.groupBy("poi_id", "v").agg(
        F.count("v").alias("c"), *(F.sum(F.when(once, F.col(x))).alias(x) for x in sums), *(F.bool_or(F.when(once, F.col(x))).alias(x) for x in flags),
    )
    # The upper median: the first value up to which more than half of a place's prices lie. No price is gathered.
    along = W.partitionBy("poi_id")
    reached = by_value.withColumn("_upto", F.sum("c").over(along.orderBy("v"))).withColumn("_half", F.floor(F.sum("c").over(along) / 2))
    said_by = reached.groupBy("poi_id").agg(
        *(F.sum(x).alias(x) for x in sums), *(F.bool_or(x).alias(x) for x in flags),
        F.min(F.when(F.col("_upto") > F.col("_half"), F.col("v"))).alias("middle"),
    )
    out = said_by.join(places.select("poi_id", "category"), "poi_id", "left")
    total = sum((F.col(f"s{n}") for n in _SYMBOL_SIZES[1:]), F.col(f"s{_SYMBOL_SIZES[0]}"))
    place, symbols, below = F.floor(total / 2), F.lit(None).cast("int"), F.lit(0)
    for n in reversed(_SYMBOL_SIZES):
        under = sum((F.col(f"s{m}") for m in _SYMBOL_SIZES if m < n), below)
        symbols = F.when(symbols.isNull() & (F.col(f"s{n}") > 0) & (place >= under) & (total > 0), n).otherwise(symbols)
    (level, _), *more = X.PRICE_WORDS
    ladder = F.when(F.col(f"w{level}"), level)
    for level, _ in more:
        ladder = ladder.when(F.col(f"w{level}"), level)
    return out.select("poi_id", F.coalesce(symbols, ladder, X.price_bracket(F.col("middle"), F.col("category"))).cast("int").alias("price_level"))


def divergences(snippets: DataFrame) -> DataFrame:
    """poi_id, divergences (array): disagreements between all of a place's snippets."""
    c = F.col("content")
    ranges = F.transform(T.all_matches(c, X.HOURS_RANGE, 0, True), F.lower)
    rates = F.filter(F.transform(T.all_matches(c, X.RATING_DOT_ONLY, 1, True), lambda r: r.try_cast("double")), lambda v: v.between(1, 5))
    rows = snippets.select("poi_id", ranges.alias("ranges"), rates.alias("rates"), T.matches(c, X.CLOSURE, True).alias("closed"), T.matches(c, X.POSITIVE, True).alias("liked"))
    seen = rows.select("poi_id", F.array_min("ranges").alias("h0"), F.array_max("ranges").alias("h1"), F.array_min("rates").alias("r0"), F.array_max("rates").alias("r1"), "closed", "liked")
    by = seen.groupBy("poi_id").agg(F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.bool_or("closed").alias("closed"), F.bool_or("liked").alias("liked"))
    return by.select("poi_id", X.divergence_texts(F.col("h0") != F.col("h1"), F.col("r0"), F.col("r1"), F.col("closed"), F.col("liked")).alias("divergences"))
