"""Predicates and ordered gates over postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.plan import named
from talus.functions.text import contains_any, least_years
from talus.operators.lexicon import Lexicon, tags

#: Fixed values.
SENIOR = r"(?i)\b(senior|sr\.?|lead|principal|staff|architect|manager|head\s+of|director|vp|vice\s+president|distinguished|fellow|chief|expert|sde\s*(?:3|iii)|sde-?3)\b"
JUNIOR = r"(?i)\b(junior|jr\.?|entry[- ]?level|entry|graduate|trainee|fresher|intern|sde\s*(?:1|i)\b|sde-?1)\b"
SENIOR_SEARCH = r"(?i)\b(senior|sr\.?|staff|principal|lead|director|head\b|vp\b|architect|manager)\b"
WRONG_FIELD = [
    "manager", "lead", "director", "vp", "principal architect", "senior principal", "distinguished engineer", "sales", "marketing",
    "support engineer", "devops engineer", "sre", "site reliability",
]
ROLE_WORDS = ["backend", "full stack", "python", "node", "java", "sde", "junior", "entry", "software developer", "software engineer", "ai engineer", "ml engineer", "llm engineer", "ai agent engineer"]
SECTION_STARTS = ["must have", "required", "skills", "expertise", "core competencies"]
SECTION_STOPS = ["\n\n", "nice to have", "preferred", "about you"]
SECTION, OPENING = 500, 1500
PLAIN_SKILLS = {
    "Python": "python",
    "Java": "java",
    "Node.js": r"node(?:\.js)?",
    "JavaScript": "javascript",
    "Backend": "backend",
    "Full Stack": r"full\s*stack",
    "FastAPI": "fastapi",
    "Express": r"express(?:\.js)?",
    "Spring": "spring",
    "Docker": "docker",
    "PostgreSQL": r"postgres(?:ql)?",
    "React": "react",
}
POSTING_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "gh_jid"]


def age_within(date: Column, as_of: Column, hours: int) -> Column:
    """At most so many hours before ``as_of``. Times without an offset are UTC; unknown and unreadable ones pass, and so does everything for 0 hours.

    A date is read whole, else its first 19 characters, else its first 10.
    """
    if not hours:
        return F.lit(True)

    def within(t: Column) -> Column:
        zoned = F.when(t.rlike(r"[0-9]T?[ 0-9:.]*(?:[+-][0-9]{2}:?[0-9]{2})$") & (F.length(t) > 10), F.try_to_timestamp(t))
        at = F.coalesce(zoned, F.try_to_timestamp(F.concat(F.substring(t, 1, 19), F.lit("Z"))), F.try_to_timestamp(F.concat(F.substring(t, 1, 10), F.lit("T00:00:00Z"))))
        return F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(at) <= hours * 3600, F.lit(True))

    return named(F.replace(F.trim(F.coalesce(date, F.lit(""))), F.lit("Z"), F.lit("+00:00")), within)


def level_fits(title: Column, level: str) -> Column:
    return F.lit(True) if level != "JUNIOR" else ~F.coalesce(title, F.lit("")).rlike(SENIOR_SEARCH)


def is_true(flag: Column) -> Column:
    """Booleans and their spellings."""
    return F.lower(F.coalesce(flag.cast("string"), F.lit(""))).isin("true", "1")


def is_posting_url(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return contains_any(u, POSTING_HOSTS) | u.rlike(r"/(jobs?|careers|openings?|positions?|vacanc\w+)/[^/?#]+")


def required_part(description: Column) -> Column:
    """The sections of a posting that ask for skills, each up to its stop; without any, the posting's opening."""

    def parts(t: Column) -> Column:
        def section(start: str) -> Column:
            def window(x: Column) -> Column:
                """``x``: the window of the section, ``low`` in lower case."""
                cuts = [F.nullif(F.instr(x["low"], stop), F.lit(0)) for stop in SECTION_STOPS]
                cut = F.least(*[F.when(c > 1, c) for c in cuts])
                return F.concat(F.substring(x["text"], F.lit(1), F.coalesce(cut - 1, F.lit(SECTION))), F.lit("\n"))

            def found(at: Column) -> Column:
                held = named(F.substring(t["text"], at, F.lit(SECTION)), lambda w: F.struct(w.alias("text"), F.lower(w).alias("low")))
                return F.when(at > 0, named(held, window))

            return named(F.instr(t["low"], start), found)

        joined = F.concat_ws("", *map(section, SECTION_STARTS))
        return F.coalesce(F.nullif(joined, F.lit("")), F.substring(t["text"], 1, OPENING))

    text = F.coalesce(description, F.lit(""))
    return named(F.struct(text.alias("text"), F.lower(text).alias("low")), parts)


def required_skills(description: Column, lexicon: Lexicon) -> Column:
    """Labels that the asking sections hold, sorted; without any, plain names of common skills."""

    def plain(low: Column) -> Column:
        return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"), F.lit(label)) for label, p in PLAIN_SKILLS.items()])))

    def asked(part: Column) -> Column:
        return named(tags(part, lexicon), lambda found: F.when(F.size(found) > 0, found).otherwise(named(F.lower(part), plain)))

    return named(required_part(description), asked)


def strict_reason(
    title: Column, description: Column, skills: Column, core: list[str], major: list[str], have_years: int, needed: Column | None = None
) -> Column:
    """Why a posting is turned down, by the first gate that fails; null where it passes.

    ``skills`` and ``needed``: what it asks for; the years are the least that the text names where they are not given.
    """
    low, text = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    starter = contains_any(low, ["sde", "entry", "junior"])
    asked = F.when((F.size(skills) == 0) & starter, F.array(F.lit("Backend"))).otherwise(skills)
    both = F.array_intersect(asked, F.array(*map(F.lit, core)))
    needed = least_years(description) if needed is None else needed
    return (
        F.when(contains_any(low, WRONG_FIELD), "wrong field")
        .when(needed > have_years + 1, F.concat(F.lit("asks for "), needed.cast("string"), F.lit(" years")))
        .when(~contains_any(low, ROLE_WORDS), "unrelated role")
        .when(F.size(asked) == 0, "no known skills")
        .when(F.size(both) == 0, "no skill overlap")
        .when((F.size(both) == 1) & ~F.arrays_overlap(both, F.array(*map(F.lit, major))), "one minor skill")
        .when(F.contains(low, F.lit("senior")) & F.contains(low, F.lit("lead")) & ~contains_any(text, ["mentor", "train", "junior", "entry"]) & F.lit(have_years < 5), "senior lead without mentoring")
    )
