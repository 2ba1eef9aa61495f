"""Web pages to previews: title, description, excerpt and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- Fixed values: patterns over page source ----------------------------------
_TITLE = r"<title[^>]*>([\s\S]*?)</title>"
_META_NAME_FIRST = r"""<meta\s+name=["']description["']\s+content=["']([\s\S]*?)["'][^>]*>"""
_META_CONTENT_FIRST = r"""<meta\s+content=["']([\s\S]*?)["']\s+name=["']description["'][^>]*>"""
_LD_JSON = r"""<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""
EXCERPT_CHARS = 1200


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags become blanks."""
    out = T.collapse(html)
    for tag in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", r"<[^>]+>"):
        out = T.replace(out, tag, " ", ignore_case=True)
    return T.collapse(out)


def _clean(col: Column) -> Column:
    return T.blank_to_null(T.collapse(col))


_NO_NODES = "CAST(array() AS array<variant>)"


def _is(node: Column, kind: str) -> Column:
    return F.schema_of_variant(node).startswith(kind)


def _field(node: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, path, kind)


def _items(node: Column) -> Column:
    """The members of an array, or the object itself."""
    return F.when(_is(node, "OBJECT"), F.array(node)).otherwise(
        F.coalesce(_field(node, "$", "array<variant>"), F.expr(_NO_NODES))
    )


_NO_PLACED = "CAST(array() AS array<struct<place:array<int>,node:variant>>)"


def _members(node: Column, place: Column) -> Column:
    """The members of an array, each with its place behind the array's own."""
    inside = F.coalesce(_field(node, "$", "array<variant>"), F.expr(_NO_NODES))
    return F.transform(inside, lambda m, i: F.struct(F.concat(place, F.array(i)).alias("place"), m.alias("node")))


def _below(item: Column) -> Column:
    """What stands right below: an array's members; an object's @graph, if an array, and its mainEntity."""
    node, place = item["node"], item["place"]
    graph, main = _field(node, "$['@graph']"), _field(node, "$.mainEntity")
    under = lambda value, k: F.array(F.struct(F.concat(place, F.array(F.lit(k))).alias("place"), value.alias("node")))
    none = F.expr(_NO_PLACED)
    children = F.concat(
        F.when(F.coalesce(_is(graph, "ARRAY"), F.lit(False)), under(graph, 0)).otherwise(none), F.when(main.isNotNull(), under(main, 1)).otherwise(none),
    )
    return F.when(_is(node, "ARRAY"), _members(node, place)).when(_is(node, "OBJECT"), children).otherwise(none)


def jsonld_nodes(html: Column) -> Column:
    """All nodes of the page's ld+json blocks, parents first, at any depth; blocks that are not JSON are skipped.

    Level by level: the opening brackets of a page's blocks bound its depth. Places put the nodes of
    all levels back into the order of the document.
    """
    blocks = T.all_matches(html, _LD_JSON, 1, ignore_case=True)

    def walked(blocks: Column) -> Column:
        parsed = F.transform(blocks, lambda b, i: F.struct(F.array(i).alias("place"), F.try_parse_json(b).alias("node")))
        tops = F.filter(parsed, lambda t: t["node"].isNotNull())
        depth = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.regexp_count(b, F.lit(r"[\[{]")))
        start = F.struct(F.expr(_NO_PLACED).alias("found"), tops.cast("array<struct<place:array<int>,node:variant>>").alias("level"))

        def step(state: Column, _: Column) -> Column:
            objects = F.filter(state["level"], lambda t: _is(t["node"], "OBJECT"))
            return F.when(F.size(state["level"]) == 0, state).otherwise(F.struct(
                F.concat(state["found"], objects).alias("found"), F.flatten(F.transform(state["level"], _below)).alias("level"),
            ))

        found = F.aggregate(F.sequence(F.lit(0), depth), start, step)["found"]
        ordered = F.array_sort(found, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
        return F.transform(ordered, lambda t: t["node"])

    return T.let(blocks, walked)


def _text_of(value: Column) -> Column:
    return F.when(_is(value, "STRING"), _clean(_field(value, "$", "string")))


def number_of(raw: Column) -> Column:
    """Number, or leading number of a text with a decimal comma."""
    return T.first_match(F.replace(raw, F.lit(","), F.lit(".")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def _first(nodes: Column, fn) -> Column:
    return F.get(F.filter(F.transform(nodes, fn), lambda x: x.isNotNull()), F.lit(0))


def structured_data(nodes: Column) -> Column:
    """First description, phone, price range and rating; all opening hours."""
    text = lambda path: _first(nodes, lambda n: _text_of(_field(n, path)))
    number = lambda n, path: number_of(_field(n, path, "string"))

    def hours(node: Column) -> Column:
        value = _field(node, "$.openingHours")
        return F.when(value.isNull(), F.expr(_NO_NODES)).when(_is(value, "STRING"), F.array(value)).otherwise(_items(value))

    opening = F.array_distinct(
        F.filter(F.transform(F.flatten(F.transform(nodes, hours)), _text_of), lambda h: h.isNotNull())
    )
    fields = F.struct(
        text("$.description").alias("description"), text("$.telephone").alias("telephone"),
        text("$.priceRange").alias("priceRange"), opening.alias("openingHours"),
        _first(nodes, lambda n: number(n, "$.aggregateRating.ratingValue")).alias("rating"),
        _first(
            nodes,
            lambda n: F.coalesce(number(n, "$.aggregateRating.reviewCount"), number(n, "$.aggregateRating.ratingCount")),
        ).alias("reviewCount"),
    )
    return fields


def with_structured_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``structured``; null when a page states none of the fields."""
    out = pages.withColumn("_nodes", jsonld_nodes(F.col(html))).withColumn("structured", structured_data(F.col("_nodes")))
    s = F.col("structured")
    empty = F.size(s["openingHours"]) == 0
    for name in ("description", "telephone", "priceRange", "rating", "reviewCount"):
        empty = empty & s[name].isNull()
    return out.withColumn("structured", F.when(~empty, s)).drop("_nodes")


def page_previews(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, excerpt and structured data of each page."""
    h = F.col(html)
    meta = F.coalesce(T.first_match(h, _META_NAME_FIRST, 1, True), T.first_match(h, _META_CONTENT_FIRST, 1, True))
    out = with_structured_data(pages, html)
    return out.select(
        *[c for c in pages.columns if c != html],
        _clean(T.first_match(h, _TITLE, 1, True)).alias("title"),
        F.coalesce(_clean(meta), F.col("structured.description")).alias("description"),
        T.blank_to_null(F.substring(page_text(h), 1, EXCERPT_CHARS)).alias("excerpt"),
        "structured",
    )
