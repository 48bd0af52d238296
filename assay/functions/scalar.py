"""Scalar functions on Columns. All stay inside generated code; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(x: Column | str) -> Column:
    """Round to six decimals, halves toward plus infinity."""
    return F.floor(_col(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def strip(x: Column | str) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def strip_markdown(x: Column | str) -> Column:
    """Take off a surrounding Markdown code fence; null stays null."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```(json)?\s*", ""), r"\s*```$", ""))


def normalize_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(x)), r"\s+", " "))


def contains_either(a: Column, b: Column) -> Column:
    """One text holds the other; the empty text is in every text."""
    return F.contains(a, b) | F.contains(b, a)


def equals_ignore_case(a: Column | str, b: Column | str) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))


def word_count(x: Column | str) -> Column:
    """Pieces between white space: a leading empty piece counts, trailing ones do not; '' is 1, blank text 0."""
    c = _col(x)
    tail = F.regexp_replace(c, r"\s+$", "")
    return F.when(c == "", F.lit(1)).when(tail == "", F.lit(0)).otherwise(F.size(F.split(tail, r"\s+")))


def clamp01(x: Column | str) -> Column:
    """A number or numeric text into [0, 1]; null where it is neither, or not a number."""
    number = _col(x).cast("string").try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def truncate(x: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last three dots if cut."""
    c = _col(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def shorten(x: Column | str, n: int) -> Column:
    """The first ``n`` characters, then three dots if there are more."""
    c = _col(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def escape_html(x: Column | str) -> Column:
    c = F.coalesce(_col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_csv(x: Column | str) -> Column:
    """Quote a cell that holds a comma, quote or line end, or that a spreadsheet would run as a formula."""
    c = F.coalesce(_col(x), F.lit(""))
    return F.when(c.rlike('[,\n"]|^[=+@-]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escape_markdown_cell(x: Column | str) -> Column:
    return F.replace(F.coalesce(_col(x), F.lit("")), F.lit("|"), F.lit("\\|"))


def format_number(x: Column | str) -> Column:
    c = _col(x)
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string("%.1f", c))


def format_value(x: Column | str) -> Column:
    """A map of texts for display: nothing for an empty one, the value of a single entry, the entry ``output``, else JSON by sorted keys."""
    c = _col(x)
    entries = F.array_sort(F.map_entries(c))
    return (
        F.when(c.isNull() | (F.size(c) == 0), F.lit(""))
        .when(F.size(c) == 1, F.map_values(c)[0])
        .when(F.map_contains_key(c, "output"), F.try_element_at(c, F.lit("output")))
        .otherwise(F.to_json(F.map_from_entries(entries)))
    )


def pretty_json(x: Column | str) -> Column:
    """Compact canonical JSON where the text parses, else the text."""
    c = _col(x)
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def says_yes(x: Column | str) -> Column:
    return F.startswith(F.lower(strip(x)), F.lit("yes"))


def java_list(x: Column | str) -> Column:
    """An array as ``[a, b]``; a null element is shown as ``null``."""
    return F.concat(F.lit("["), F.array_join(_col(x), ", ", "null"), F.lit("]"))


def base_name(x: Column | str) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.substring_index(_col(x), "/", -1), r"\.[^.]*$", "")


def safe_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def duration(start: Column | str, end: Column | str) -> Column:
    """``42s`` or ``3m 5s``; a dash while there is no end."""
    s = F.floor((F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))) / F.lit(1_000_000)).cast("long")
    long_ = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return F.when(_col(end).isNull(), F.lit("—")).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long_)


def pass_rate_bucket(x: Column | str) -> Column:
    c = _col(x)
    return F.when(c < 0.5, F.lit("low")).when(c < 0.8, F.lit("medium")).when(c.isNotNull(), F.lit("high"))


def relevance_bucket(x: Column | str) -> Column:
    c = _col(x)
    return F.when(c >= 0.7, F.lit("high")).when(c >= 0.3, F.lit("partial")).otherwise(F.lit("irrelevant"))
