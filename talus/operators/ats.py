"""How well a resume reads for a machine: a score, what speaks for it, what is missing, and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.plan import named
from talus.functions.text import EMAIL, contains_any, occurrences
from talus.operators.scoring import HARD_SKILLS

# Words of titles, sections with points, verbs, words of a place, a telephone number, a year.
TITLES = ["backend", "frontend", "full stack", "software engineer", "developer", "python", "java", "senior", "lead", "architect"]
SECTIONS = {"experience": 5, "education": 5, "skills": 5, "projects": 3, "certifications": 2}
VERBS = ["developed", "designed", "implemented", "built", "created", "managed", "led", "improved", "optimized", "deployed"]
PLACES = ["location", "based in", "located", "noida", "bangalore", "mumbai"]
NUMBER = r"(\+[0-9]{1,3}|0)[0-9]{6,}|\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}"
YEAR = r"20[0-9]{2}"
#: Least letters of a resume, of a full page, and of a long and a short section of skills; entries of a list at most.
SHORT, PAGE, LONG_SECTION, SECTION, ENTRIES = 100, 500, 80, 50, 5
#: Most points of skills, sections, skills' presentation; a generated resume's extra points and least score.
MOST_SKILLS, MOST_FORMAT, MOST_SHOWN, EXTRA, LEAST = 35, 20, 20, 10, 85
# End of fixed values.
RESULT = "struct<score:int,strengths:array<string>,gaps:array<string>,advice:array<string>>"


def _count(low: Column, words: list[str]) -> Column:
    return sum((F.when(F.contains(low, F.lit(w)), occurrences(low, w)).otherwise(0) for w in words), F.lit(0))


def _listed(*rows: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(fits, F.lit(text) if isinstance(text, str) else text) for fits, text in rows]))


def ats_score(resume: Column, generated: Column | None = None) -> Column:
    """(score, strengths, gaps, advice) of a resume: points for skills, title, sections, dates and verbs, shown skills, contacts.

    A text under 100 letters (blanks at its ends aside) scores 0. A generated resume gets a point for each skill (up to 10), 10
    more, and 85 at least. Skills count by plain occurrences, each up to twice its points. Lists hold five entries at most;
    advice follows from all gaps. Null texts are empty. Each part is computed once.
    """
    made = F.coalesce(generated, F.lit(False)) if generated is not None else F.lit(False)

    def parts(t: Column) -> Column:
        text, low = t["text"], t["low"]
        skills = {k: F.when(F.contains(low, F.lit(k)), occurrences(low, k)).otherwise(0) for k in HARD_SKILLS}
        points = F.array(*[F.least(n * HARD_SKILLS[k], F.lit(2 * HARD_SKILLS[k])) for k, n in skills.items()])
        present = F.array(*[F.contains(low, F.lit(s)) for s in SECTIONS])
        at = F.instr(low, "skills")
        return F.struct(
            points.alias("points"), sum((F.contains(low, F.lit(w)).cast("int") for w in TITLES), F.lit(0)).alias("titles"), present.alias("present"),
            F.size(F.regexp_extract_all(low, F.lit(YEAR), F.lit(0))).alias("years"), _count(low, VERBS).alias("verbs"),
            F.when(at > 0, F.length(low) - at + 1).otherwise(0).alias("section"),
            F.when(F.contains(text, F.lit(",")) | F.contains(text, F.lit("•")), 8).when(F.contains(text, F.lit("-")), 5).otherwise(0).alias("list"),
            text.rlike(EMAIL).alias("email"), text.rlike(NUMBER).alias("phone"), contains_any(low, PLACES).alias("place"), contains_any(low, ["linkedin", "github"]).alias("links"), F.length(text).alias("length"),
        )

    def sums(p: Column) -> Column:
        """Adds what later parts read more than once."""
        found = F.size(F.filter(p["points"], lambda n: n > 0))
        skill = F.least(F.lit(MOST_SKILLS), F.aggregate(p["points"], F.lit(0), lambda a, n: a + n))
        sections = F.size(F.filter(p["present"], lambda x: x))
        each = F.aggregate(F.zip_with(p["present"], F.array(*map(F.lit, SECTIONS.values())), lambda x, n: F.when(x, n).otherwise(0)), F.lit(0), lambda a, n: a + n)
        return F.struct(p.alias("p"), found.alias("found"), skill.alias("skill"), sections.alias("sections"), each.alias("each"))

    def total(s: Column) -> Column:
        p = s["p"]
        title = F.when(p["titles"] >= 2, 15).when(p["titles"] == 1, 8).otherwise(0)
        form = F.least(s["each"] + F.when(s["sections"] >= 3, 0).when(s["sections"] == 2, -5).otherwise(-10), F.lit(MOST_FORMAT))
        clear = F.when(p["years"] >= 2, 8).otherwise(0) + F.when(p["verbs"] >= 5, 7).otherwise(0)
        shown = F.least(F.when(p["section"] > LONG_SECTION, 12).when(p["section"] > SECTION, 8).otherwise(0) + p["list"], F.lit(MOST_SHOWN))
        reach = sum((F.when(p[k], n).otherwise(0) for k, n in (("email", 3), ("phone", 2), ("place", 3), ("links", 2))), F.lit(0))
        bonus = F.when(made, F.least(F.lit(EXTRA), s["found"])).otherwise(0)
        return F.struct(s.alias("s"), (s["skill"] + bonus + title + form + clear + shown + reach).alias("score"))

    def result(x: Column) -> Column:
        s, score = x["s"], x["score"]
        p = s["p"]
        strengths = _listed(
            (s["found"] > 0, F.concat(F.lit("hard skills: "), s["found"].cast("string"))), (p["titles"] >= 2, "clear title"), (s["sections"] >= 3, F.concat(F.lit("sections: "), s["sections"].cast("string"))),
            (p["years"] >= 2, "dates"), (p["verbs"] >= 5, "action verbs"), (p["section"] > LONG_SECTION, "long skills section"), ((p["section"] > SECTION) & (p["section"] <= LONG_SECTION), "skills section"), (p["list"] == 8, "skills as a list"),
        )
        gaps = _listed(
            (s["found"] == 0, "no hard skills"), (p["titles"] == 0, "no technical title"), (s["sections"] == 2, "sections missing"), (s["sections"] < 2, "no structure"), (p["years"] < 2, "no dates"),
            (p["verbs"] < 5, F.concat(F.lit("action verbs: "), p["verbs"].cast("string"))), (p["list"] == 0, "no list of skills"), (~p["email"], "no e-mail address"), (~p["phone"], "no telephone number"), (~p["place"], "no place"), (~p["links"], "no profile links"),
        )
        advice = _listed(
            (p["titles"] == 0, "name the title"), (p["years"] < 2, "date each role"), (p["verbs"] < 5, "use action verbs"), ((p["list"] == 0) | ~p["place"], "use one column and a plain format"), (s["sections"] < 2, "use standard sections"),
            (~p["email"] | ~p["phone"], "put contacts on top"), (p["length"] < PAGE, "write more"), (score < 50, "rebuild around hard skills"), ((score >= 50) & (score < 70), "add hard skills"), ((score >= 70) & (score < 85), "match more keywords"),
        )
        final = F.least(F.lit(100), F.when(made, F.greatest(score + EXTRA, F.lit(LEAST))).otherwise(score)).cast("int")
        first = lambda xs: F.slice(xs, 1, ENTRIES)
        return F.struct(final.alias("score"), first(strengths).alias("strengths"), first(gaps).alias("gaps"), first(advice).alias("advice"))

    text = F.coalesce(resume, F.lit(""))
    none = F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("strengths"), F.array(F.lit("too short")).alias("gaps"), F.array(F.lit("send a whole resume")).alias("advice")).cast(RESULT)
    whole = named(named(named(named(F.struct(text.alias("text"), F.lower(text).alias("low")), parts), sums), total), result)
    return F.when(F.length(F.trim(text, F.lit(" \t\r\n\x0b\x0c"))) < SHORT, none).otherwise(whole)
