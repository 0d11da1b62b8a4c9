"""Text expressions over columns. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.references import unescaped

#: What is trimmed from the ends of texts of pages (fixed values).
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that say nothing about a search (fixed values).
KEYWORD_STOP = ["developer", "engineer", "engineering", "the", "and", "for", "with", "senior", "junior", "lead", "sde", "dev"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"
YEARS = r"(?i)(\d{1,2})\s*\+?\s*(?:years|yrs|yr)\b"


def strip_html(c: Column, decoded: Callable[[Column], Column] = unescaped, white: str = WHITE) -> Column:
    """Running text of an HTML fragment: scripts and styles go, line and paragraph ends become line feeds.

    ``decoded`` decodes references once the markup is gone, ``white`` is trimmed from the ends.
    """
    c = F.coalesce(c, F.lit(""))
    for pattern, by in (
        (r"(?isu)<script.*?>.*?</script>", " "),
        (r"(?isu)<style.*?>.*?</style>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p>", "\n"),
        (r"<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(F.regexp_replace(decoded(c), r"[ \t]+", " "), F.lit(white))


def first_match(c: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 0)


def first_line(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), "\n", 1)


def url_key(c: Column) -> Column:
    """Scheme, ``www.``, query, fragment and closing slash do not tell pages apart."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")


def url_host(c: Column) -> Column:
    return F.regexp_extract(url_key(c), r"^[^/]*", 0)


def has_word(c: Column, alias: str) -> Column:
    """``alias`` stands in the text as a word of its own; ``+ # .`` belong to words. Also an SQL pattern of DuckDB."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(word_pattern(alias))


def word_pattern(alias: str) -> str:
    quoted = "".join(f"\\{x}" if x in r".+*?()[]{}|^$\#-" and x != "#" else x for x in alias.strip().lower())
    return rf"(^|[^a-z0-9+#.]){quoted}([^a-z0-9+#]|$)"


def years(c: Column) -> Column:
    """All "N years" of a text, up to 20."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(YEARS), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x <= 20)


def most_years(c: Column) -> Column:
    return F.coalesce(F.array_max(years(c)), F.lit(0))


def least_years(c: Column) -> Column:
    return F.coalesce(F.array_min(years(c)), F.lit(0))


def stated_years(c: Column) -> Column:
    """The least number, up to 20, that stands before "year" on one line; 0 without any. Each match ends at its "year"."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)([0-9]+)\s*[+-]?[^\n]*?years?"), F.lit(1))
    return F.coalesce(F.array_min(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x <= 20)), F.lit(0))


def keyword_tokens(keywords: Column) -> Column:
    """Distinct telling tokens of an array of phrases, in order."""
    parts = F.split(F.lower(F.array_join(keywords, " ")), r"[^a-z0-9+#]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(KEYWORD_STOP)))


def keyword_match(text: Column, keywords: Column) -> Column:
    """Any token occurs in the text, or there are none."""
    tokens, low = keyword_tokens(keywords), F.lower(F.coalesce(text, F.lit("")))
    return (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(low, t))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def names_any(c: Column, needles: list[str]) -> Column:
    """As ``contains_any``, for short texts and many needles: one pattern, so the text is computed once."""
    return c.rlike("|".join(re.escape(n) for n in needles))


def occurrences(c: Column, needle: str) -> Column:
    """Times that a non-empty string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def company_key(c: Column) -> Column:
    """A company's name without its legal form and punctuation."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(pvt\.?|private|limited|ltd\.?|llp|inc\.?|corp\.?|the)\b", "")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of each item, in order; blanks go."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
