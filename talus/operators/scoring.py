"""Scores as sums of conditional columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once, named
from talus.functions.text import EMAIL, PHONE, contains_any, first_match, least_years, most_years, occurrences
from talus.operators.filters import JUNIOR, SENIOR, is_true
from talus.operators.lexicon import Lexicon, tags

#: Title words that do not tell roles apart, and those of one family (fixed values).
TITLE_STOP = ["developer", "engineer", "senior", "junior", "sr", "jr", "lead", "staff", "principal", "i", "ii", "iii", "the", "a", "of"]
TITLE_FAMILY = ["developer", "engineer", "programmer", "sde", "architect", "dev"]
#: Points of hard skills in a resume (fixed values).
HARD_SKILLS = {
    "python": 4, "java": 4, "javascript": 4, "node.js": 4, "go": 4, "rust": 4, "react": 3, "angular": 3, "vue": 3, "aws": 4,
    "gcp": 4, "azure": 4, "docker": 4, "kubernetes": 4, "postgresql": 3, "mongodb": 3, "redis": 3, "api": 3, "rest": 3,
    "microservices": 4, "ci/cd": 4, "devops": 4, "fastapi": 3, "django": 3, "spring": 3, "git": 2, "sql": 3, "nosql": 2,
}


@dataclass(frozen=True)
class Profile:
    titles: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    domains: dict[str, list[str]] = field(default_factory=dict)
    home: list[str] = field(default_factory=list)
    big_companies: list[str] = field(default_factory=list)
    years: int = 0
    pay: float = 7.0


def words_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z+#.]+"), F.lit(0)))


def title_relevance(title: Column, titles: list[str]) -> Column:
    """1 for the same speciality, 0.3 for the same family of roles, 0 for another field; 0.5 without titles to compare."""
    if not titles:
        return F.lit(0.5)
    words = words_of(title)
    family = F.arrays_overlap(words, F.array(*map(F.lit, TITLE_FAMILY)))
    best = []
    for t in titles:
        own = F.array_except(words_of(F.lit(t)), F.array(*map(F.lit, TITLE_STOP)))
        share = F.size(F.array_intersect(own, words)) / F.size(own)
        best.append(
            F.when(F.size(own) == 0, F.when(family, 0.5).otherwise(0.0)).when((share == 0) & family, 0.3).otherwise(share)
        )
    return F.greatest(*best, F.lit(0.0))


def yearly_pay(low: Column, high: Column, interval: Column) -> Column:
    """In units of 100,000 a year; 0 where unknown, small, or paid by less than the month."""
    amount = F.coalesce(F.nullif(high.try_cast("double"), F.lit(0.0)), low.try_cast("double"), F.lit(0.0))
    per = F.lower(F.coalesce(interval, F.lit("")))
    amount = F.when(F.contains(per, F.lit("month")), amount * 12).when(contains_any(per, ["hour", "day", "week"]), 0.0).otherwise(amount)
    return F.when(amount >= 100000, amount / 100000).otherwise(0.0)


def pay_boost(pay: Column, current: float) -> Column:
    return F.when(pay > current, F.least(F.lit(15), F.bround((pay - current) * 2).cast("int"))).otherwise(0)


def days_old(date: Column, as_of: Column) -> Column:
    d = F.try_to_date(F.substring(F.trim(F.coalesce(date.cast("string"), F.lit(""))), 1, 10), "yyyy-MM-dd")
    return F.when(d.isNull(), 9999).otherwise(F.greatest(F.datediff(as_of, d), F.lit(0)))


def recency_boost(days: Column) -> Column:
    return F.when(days <= 1, 12).when(days <= 3, 8).when(days <= 7, 4).when(days <= 14, 1).otherwise(0)


def headcount(c: Column) -> Column:
    digits = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(",")), r"\d+", 0)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def level_of(years: Column) -> Column:
    return F.when(years <= 2, "JUNIOR").when(years <= 5, "MID").when(years <= 8, "SENIOR").otherwise("LEAD")


def _blob() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))


def add_facts(postings: DataFrame, lexicon: Lexicon, p: Profile, as_of: Column) -> DataFrame:
    """What both scorers look at, each computed once."""
    facts = postings.withColumns(
        {
            "skills": tags(_blob(), lexicon),
            "least_years": least_years(_blob()),
            "most_years": most_years(_blob()),
            "senior": F.coalesce("title", F.lit("")).rlike(SENIOR),
            "junior": F.coalesce("title", F.lit("")).rlike(JUNIOR),
            "relevance": title_relevance(F.col("title"), p.titles),
            "remote": is_true(F.col("is_remote")),
            "employees": headcount(F.col("company_num_employees")),
            "big": contains_any(F.concat(F.lit(" "), F.lower(F.coalesce("company", F.lit(""))), F.lit(" ")), p.big_companies),
            "pay": yearly_pay(F.col("min_amount"), F.col("max_amount"), F.col("interval")),
            "days": days_old(F.col("date_posted"), as_of),
        }
    )
    return computed_once(facts)


def match_score(postings: DataFrame, lexicon: Lexicon, p: Profile, as_of: Column) -> DataFrame:
    """Adds matched, missing, skill_ratio, score (0 to 100) and reason (the first hard gate that fails, else null).

    The ratio is kept, so that a strict and a relaxed gate can be told from one plan.
    """
    df = add_facts(postings, lexicon, p, as_of)
    have = F.array(*map(F.lit, p.skills)).cast("array<string>")
    asked, known = F.size("skills") > 0, bool(p.skills)
    df = df.withColumn("matched", F.array_intersect("skills", have) if known else F.col("skills"))
    df = df.withColumn("missing", F.slice(F.array_except("skills", have), 1, 6) if known else have)
    df = df.withColumn("skill_ratio", F.when(asked & F.lit(known), F.size("matched") / F.size("skills")))
    cy, need = p.years, F.col("least_years")
    low = F.lower(_blob())
    at_home = contains_any(F.lower(F.coalesce("location", F.lit(""))), p.home) | contains_any(low, p.home)
    hybrid = low.rlike(r"\b(hybrid|work[\s-]?from[\s-]?office|wfo|on[\s-]?site|in[\s-]?office)\b")
    points = [
        F.when(F.col("skill_ratio").isNotNull(), F.col("skill_ratio") * 50).when(~asked, 6.0 if known else 14.0).otherwise(F.least(F.lit(50.0), F.size("skills") * 8.0)),
        F.when(need == 0, 12).when(F.lit(cy == 0), 10).when(need <= cy, 20).when(need <= cy + 1, 8).otherwise(0),
        F.when(F.col("junior"), 8).otherwise(0),
        F.col("relevance") * 15,
        F.when(F.col("relevance") >= 0.8, 10).otherwise(0),
        F.when(contains_any(low, [n for needles in p.domains.values() for n in needles]), 10).otherwise(0),
        F.when(at_home, F.when(hybrid, 13).otherwise(10)).when(F.col("remote"), 3).otherwise(0),
        F.when(F.col("employees") >= 500, 6).when(F.col("employees") >= 150, 3).otherwise(0),
        F.when(F.col("big"), 6).otherwise(0),
        pay_boost(F.col("pay"), p.pay),
        recency_boost(F.col("days")),
    ]
    total = points[0]
    for x in points[1:]:
        total = total + x
    reason = (
        F.when((need > cy + 1) & F.lit(cy > 0), "too many years")
        .when(F.col("senior") & ~F.col("junior") & F.lit(0 < cy < 5), "senior title")
        .when((F.col("relevance") == 0) & F.lit(bool(p.titles)), "unrelated title")
    )
    return computed_once(df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total).cast("int")))).withColumn("reason", reason))


def generic_score(postings: DataFrame, lexicon: Lexicon, targets: list[str], p: Profile, as_of: Column) -> DataFrame:
    """Adds matched, base and score: overlap with the wanted labels, then soft boosts; nothing is turned down here."""
    df = add_facts(postings, lexicon, p, as_of)
    if targets:
        n = max(1, min(len(targets), 8))
        df = df.withColumn("matched", F.array_intersect("skills", F.array(*map(F.lit, targets))))
        df = df.withColumn("base", F.bround(F.least(F.size("matched"), F.lit(n)) * 100 / n).cast("int"))
    else:
        df = df.withColumn("matched", F.col("skills")).withColumn("base", F.least(F.lit(100), F.size("skills") * 12))
    need, cy = F.col("most_years"), p.years
    years = F.when((need == 0) | F.lit(cy == 0), 0).when(need <= cy + 1, 10).otherwise(-F.least(F.lit(45), (need - cy) * 8))
    total = (
        F.col("base")
        + years
        + F.when(F.col("senior"), -20).otherwise(0)
        + F.when(F.col("remote"), 8).otherwise(0)
        + F.when(F.col("employees") >= 500, 12).when(F.col("employees") >= 150, 6).otherwise(0)
        + F.when(F.col("big"), 10).otherwise(0)
        + pay_boost(F.col("pay"), p.pay)
        + recency_boost(F.col("days"))
    )
    return df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))


#: A border between an ASCII word character and another one; what Java takes for a word differs between its versions.
BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Pay named in a description, in units of 100,000 (fixed value).
PAY = r"(?i)([0-9]{1,2})\s*(?:lpa|l|lakhs?|rupees?|₹)"


def ascii_borders(pattern: str) -> str:
    """``pattern`` with ASCII word borders. At its ends, where a word character surely stands beside them, one look is enough."""
    begins = re.match(r"\\b(?=[A-Za-z0-9_]|\((?:\?:)?[A-Za-z0-9_|]+\))", pattern)
    ends = re.search(r"(?<=[A-Za-z0-9_])\??\\b$|(?<=[A-Za-z0-9_]\))\\b$", pattern)
    if ends and ends[0].startswith("?") and not re.search(r"[A-Za-z0-9_]{2}\?\\b$", pattern):
        ends = None
    if begins:
        pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
    if ends:
        pattern = pattern[:-2] + "(?![A-Za-z0-9_])"
    return pattern.replace(r"\b", BORDER)


def signal_count(low: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in a lower-case text. Their word borders are ASCII ones."""
    return sum((low.rlike(ascii_borders(p)).cast("int") for p in patterns), F.lit(0))


def signals(description: Column, junior: list[str], senior: list[str], mentor: list[str]) -> Column:
    """(delta, fit) of a description by counts of its signals; a text under 50 letters says nothing. Each pattern is tried once."""
    text = F.coalesce(description, F.lit(""))

    def counted(low: Column) -> Column:
        found = {"j": junior, "s": senior, "m": mentor}
        return F.struct(*[signal_count(low, p).alias(k) for k, p in found.items()], F.regexp_extract(text, PAY, 1).try_cast("int").alias("pay"))

    def judged(c: Column) -> Column:
        j, s, m, pay = (c[k] for k in ("j", "s", "m", "pay"))
        raw = (
            F.when(j >= 2, 12).when(j == 1, 6).otherwise(0)
            - F.when(s >= 2, 10).otherwise(0)
            + F.when((m >= 1) & (s >= 1), 8).otherwise(0)
            + F.when(pay.between(5, 12), 3).when(pay > 15, -5).otherwise(0)
        )
        delta = F.when(s >= 3, -20).otherwise(F.greatest(F.lit(-20), F.least(F.lit(15), raw)))
        return F.struct(delta.alias("delta"), F.when(s >= 3, False).when(raw > 5, True).when(raw < -5, False).alias("fit"))

    nothing = F.struct(F.lit(0).alias("delta"), F.lit(None).cast("boolean").alias("fit"))
    return F.when(F.length(F.trim(text)) < 50, nothing).otherwise(named(named(F.lower(text), counted), judged))


def hard_skill_points(resume: Column) -> Column:
    """Up to 35 points; each skill up to twice its points, by plain occurrences. Resumes under 100 letters get none."""

    def points(low: Column) -> Column:
        total = sum((F.when(F.contains(low, F.lit(k)), F.least(occurrences(low, k) * v, F.lit(2 * v))).otherwise(0) for k, v in HARD_SKILLS.items()), F.lit(0))
        return F.when(F.length(F.trim(low)) < 100, 0).otherwise(F.least(F.lit(35), total))

    return named(F.lower(F.coalesce(resume, F.lit(""))), points)


def contact_points(resume: Column) -> Column:
    """5 points each for an e-mail address and a telephone number."""
    return F.when(first_match(resume, EMAIL) != "", 5).otherwise(0) + F.when(first_match(resume, PHONE) != "", 5).otherwise(0)


#: Least scores of a label and of a colour (fixed values).
LABELS = [(85, "Excellent"), (70, "Good"), (50, "Fair"), (30, "Poor"), (None, "Critical")]
COLOURS = [(80, "#16a34a"), (60, "#eab308"), (40, "#f97316"), (None, "#dc2626")]


def step(score: Column, steps: list[tuple[int | None, str]]) -> Column:
    """The first value whose least score is reached; the last one otherwise."""
    out = F.lit(steps[-1][1])
    for least, value in reversed(steps[:-1]):
        out = F.when(score >= least, value).otherwise(out)
    return out
