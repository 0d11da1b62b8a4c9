"""Character references of HTML, decoded in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.plan import named

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What the code points 128 to 159 stand for, as bytes of windows-1252; the five it lacks stay as they are (fixed rule).
LATIN = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
#: Names that also count without their semicolon, and before further letters.
SHORT = {k: v for k, v in html5.items() if not k.endswith(";")}


def _table(entries: dict) -> Column:
    """A map as one constant, which the optimiser folds, however many entries there are."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _by_letter(entries: dict[str, str]) -> Callable[[Column], Column]:
    """Looks a name up in a constant that is cut by first letters, as maps are searched entry by entry; null where it is not there."""
    cut: dict[str, dict[str, str]] = {}
    for name, value in entries.items():
        cut.setdefault(name[0], {})[name] = value
    table = F.from_json(F.lit(json.dumps(cut)), "map<string,map<string,string>>")
    return lambda name: F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)


def _named_reference(ref: Column) -> Column:
    """A name of the table, else the longest short name that it begins with, else the reference itself."""
    name = F.substr(ref, F.lit(2))
    whole, short = _by_letter(html5), _by_letter(SHORT)
    begins = []
    for n in range(max(map(len, SHORT)), min(map(len, SHORT)) - 1, -1):
        begins.append(F.when(F.length(name) > n, F.concat(short(F.substring(name, 1, n)), F.substr(name, F.lit(n + 1)))))
    return F.coalesce(whole(name), *begins, ref)


def _numeric_reference(ref: Column) -> Column:
    """The code point; null, surrogates and those beyond Unicode are U+FFFD, and those that no document may hold nothing."""
    digits = F.regexp_extract(ref, r"([0-9a-fA-F]+);?$", 1)
    stripped = F.regexp_replace(digits, "^0+", "")
    hexadecimal = F.lower(F.substring(ref, 3, 1)) == "x"
    far = F.length(stripped) > 9
    code = F.when(far, 0x110000).otherwise(F.when(hexadecimal, F.conv(stripped, 16, 10)).otherwise(stripped).try_cast("long"))

    def char(n: Column) -> Column:
        control = n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
            .when(n.between(0x80, 0x9F), F.try_element_at(_table(LATIN), n.cast("string")))
            .when(n == 13, "\r")
            .when(control, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return named(F.coalesce(code, F.lit(0)), char)


def unescaped(text: Column) -> Column:
    """``text`` with named and numeric references decoded once; what is no reference stays. Null stays null."""

    def decoded(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        chars = F.transform(refs, lambda r: F.when(F.substring(r, 2, 1) == "#", _numeric_reference(r)).otherwise(_named_reference(r)))
        pieces = F.zip_with(F.split(t, REFERENCE, -1), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return named(text, decoded)
