"""Tagging of texts by a lexicon: a mapping of label to aliases, given by the caller."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import word_pattern

Lexicon = dict[str, list[str]]


#: An alias of these characters only is one whole run of them.
RUN = re.compile(r"[a-z0-9+#]+")


def tags(text: Column, lexicon: Lexicon) -> Column:
    """Labels with an alias that stands in the text as a word, sorted.

    Aliases of one run of letters are found in one pass over the text, others by a pattern of their own.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    runs: dict[str, list[str]] = {}
    others: dict[str, list[str]] = {}
    for label, aliases in sorted(lexicon.items()):
        for a in (x.strip().lower() for x in aliases):
            if RUN.fullmatch(a):
                runs.setdefault(a, []).append(label)
            else:
                others.setdefault(label, []).append(a)
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(map(word_pattern, a))), F.lit(x)) for x, a in others.items()], F.lit(None).cast("string")))
    if runs:
        one = "|".join(a.replace("+", r"\+") for a in sorted(runs))
        met = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9+#.])(?:{one})(?![a-z0-9+#])"), F.lit(0)))
        labels = F.create_map(*[c for a, x in sorted(runs.items()) for c in (F.lit(a), F.array(*map(F.lit, x)))])
        found = F.concat(found, F.flatten(F.transform(met, lambda a: F.element_at(labels, a))))
    return F.array_sort(F.array_distinct(found))


def ordered_tags(text: Column, lexicon: Lexicon) -> Column:
    """The same labels by where an alias first occurs, as a plain substring; ties by label."""
    low = F.lower(F.coalesce(text, F.lit("")))
    aliases = F.create_map(*[c for x, a in sorted(lexicon.items()) for c in (F.lit(x), F.array(*[F.lit(y.strip().lower()) for y in a]))])

    def placed(label: Column) -> Column:
        places = F.filter(F.transform(F.element_at(aliases, label), lambda a: F.instr(low, a)), lambda n: n > 0)
        return F.struct(F.array_min(places).alias("at"), label.alias("label"))

    return F.transform(F.array_sort(F.transform(tags(text, lexicon), placed)), lambda x: x["label"])


def alias_map(rows: DataFrame) -> DataFrame:
    """(label, aliases) of a lexicon's rows (ord, label, alias): labels lose their parentheses, and those that are then alike share their aliases, by ``ord``."""
    clean = F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s*\(.*?\)\s*", " "))
    listed = rows.where("alias is not null").groupBy(clean.alias("label")).agg(F.array_sort(F.collect_list(F.struct("ord", "alias"))).alias("a"))
    return listed.select("label", F.transform("a", lambda x: x["alias"]).alias("aliases"))
