"""Text helpers whose results follow ECMAScript string rules.

Tables that reach this engine were produced and tested under those rules:
rounding is half towards plus infinity, ``\\s`` includes the no-break space,
``\\b`` is an ASCII word boundary, and case folding covers accented letters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space besides the ASCII ones.
EXTRA_SPACE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
_STARTS_WORD = re.compile(r"\(?(?:[A-Za-z0-9]|\\d|\[[0-9])")
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def pattern(source: str, ignore_case: bool = False) -> str:
    """Spell a pattern for Spark's regex functions.

    ``\\s``, ``\\S`` and ``\\b`` get the meaning given in the module text, inside
    and outside of character classes.
    """
    out, in_class, i = [], False, 0
    while i < len(source):
        ch = source[i]
        if ch == "\\" and i + 1 < len(source):
            token = source[i : i + 2]
            if token == r"\s":
                out.append(rf"\s{EXTRA_SPACE}" if in_class else rf"[\s{EXTRA_SPACE}]")
            elif token == r"\S" and not in_class:
                out.append(rf"[^\s{EXTRA_SPACE}]")
            elif token == r"\b" and not in_class:
                # Before an ASCII word character only the start of a word is possible.
                out.append(f"(?<!{_WORD})" if _STARTS_WORD.match(source, i + 2) else _BOUNDARY)
            else:
                out.append(token)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def matches(col: Column, source: str, ignore_case: bool = False) -> Column:
    return col.rlike(pattern(source, ignore_case))


def first_match(col: Column, source: str, group: int = 0, ignore_case: bool = False) -> Column:
    """Group of the first match; null without a match or when the group took no part."""
    found = F.regexp_extract(col, pattern(source, ignore_case), group)
    return F.nullif(found, F.lit(""))


def all_matches(col: Column, source: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern(source, ignore_case)), F.lit(group))


def replace(col: Column, source: str, by: str | Column, ignore_case: bool = False) -> Column:
    return F.regexp_replace(col, F.lit(pattern(source, ignore_case)), F.lit(by) if isinstance(by, str) else by)


# All of them spelled out, for trimming without a pattern.
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(col: Column) -> Column:
    """Trim white space; looks at the ends only, however long the text is."""
    return F.btrim(col, F.lit(_SPACES))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(replace(col, r"\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def js_round(col: Column) -> Column:
    """Round half towards plus infinity, as a long."""
    return F.floor(col + F.lit(0.5)).cast("long")


def round_to(col: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def one_decimal(col: Column) -> Column:
    """Number as text with exactly one decimal."""
    return F.when(col.isNotNull(), F.format_string("%.1f", col))


def number_text(col: Column) -> Column:
    """Double as the shortest text: no trailing ``.0``."""
    text = col.cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Higher-order functions are interpreted, without sharing of equal parts, so a
    costly value that is used several times is bound to a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shorten(col: Column, limit: int) -> Column:
    """Collapse white space, then cut to ``limit`` characters with an ellipsis."""
    return let(collapse(col), lambda v: F.when(F.char_length(v) <= limit, v).otherwise(
        F.concat(F.trim(F.substring(v, 1, limit - 1)), F.lit("…"))
    ))


def truncate_words(col: Column, limit: int) -> Column:
    """Cut on a word boundary when one lies beyond 60 % of the limit.

    Null gives the empty string.
    """
    def cut(value: Column) -> Column:
        head = F.substring(value, 1, limit - 1)
        # Null when there is no blank far enough behind the start.
        whole_words = first_match(head, rf"(?s)^(.{{{int(limit * 0.6) + 1},}}) [^ ]*$", 1)
        shortened = replace(F.coalesce(whole_words, head), r"[,.;:!?\-—\s]+$", "")
        return F.when(F.char_length(value) <= limit, value).otherwise(F.concat(shortened, F.lit("…")))

    return let(collapse(F.coalesce(col, F.lit(""))), cut)


def first_upper(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def compact_array(*cols: Column) -> Column:
    """Array of the non-null values, in order."""
    return F.array_compact(F.array(*cols))


def unique_texts(array: Column) -> Column:
    """Trim, drop blanks, keep the first of equal strings."""
    trimmed = F.transform(array, strip)
    return F.array_distinct(F.filter(trimmed, lambda s: s.isNotNull() & (s != "")))


def sql_text(value: str) -> str:
    """Literal for an expression string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a small fixed table; null when absent."""
    literal = F.expr("map(" + ", ".join(sql_text(x) for pair in table.items() for x in pair) + ")")
    return literal[key]


def escape_xml(col: Column) -> Column:
    out = col
    # The five XML entities, ampersand first.
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"),
    ):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def percent_encode(col: Column) -> Column:
    """URI-component encoding: blanks become %20 and ``!'()*~`` stay as they are."""
    out = F.url_encode(col)
    for char, code in ((" ", "\\+"), ("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.regexp_replace(out, code, "%20" if char == " " else char)
    return out
