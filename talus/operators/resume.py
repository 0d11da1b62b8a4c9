"""Resume and job-description text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import named
from talus.functions.text import distinct_ignoring_case, occurrences
from talus.operators.lexicon import Lexicon, tags

#: Words that are headings by themselves (fixed values).
HEADINGS = ["summary", "skills", "experience", "education", "projects", "certifications"]


def tailor(resume: Column, job: Column, extra: Column, lexicon: Lexicon) -> dict[str, Column]:
    """What a job asks for: labels the resume has, labels typed in by hand, and labels that neither has."""
    asked, have, typed = (tags(c, lexicon) for c in (job, resume, extra))
    return {
        "present": F.array_intersect(asked, have),
        "typed": F.array_except(typed, have),
        "suggestions": F.array_except(F.array_except(asked, have), typed),
    }


def split_skills(text: Column, lexicon: Lexicon) -> Column:
    """(primary, secondary): a skill is secondary if it occurs once, in the last fifth of a text of 400 letters or more."""

    def late(low: Column) -> Column:
        """Labels of which one alias occurs, once, and late."""
        out = []
        for label, aliases in sorted(lexicon.items()):
            count = sum((F.when(F.contains(low, F.lit(a)), occurrences(low, a)).otherwise(0) for a in (x.lower() for x in aliases)), F.lit(0))
            first = F.array_min(F.array(*[F.when(F.locate(a.lower(), low) > 0, F.locate(a.lower(), low) - 1) for a in aliases]))
            out.append(F.when((first >= 0.8 * F.length(low)) & (count == 1), F.lit(label)))
        return F.when(F.length(low) >= 400, F.array_compact(F.array(*out))).otherwise(F.array().cast("array<string>"))

    both = F.struct(tags(text, lexicon).alias("found"), named(F.lower(F.coalesce(text, F.lit(""))), late).alias("late"))
    return named(both, lambda b: F.struct(F.array_except(b["found"], b["late"]).alias("primary"), F.array_intersect(b["found"], b["late"]).alias("secondary")))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, line, kind): bullet, contact, heading or body for each non-blank line."""
    rows = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n", "raw"))
    rows = rows.withColumn("line", F.trim("raw")).where("line <> ''").drop("raw")
    line = F.col("line")
    letters = F.length(F.regexp_replace(line, r"[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(line, r"[^A-Z]", ""))
    short = (F.size(F.split(line, r"\s+")) <= 5) & (F.length(line) <= 40)
    heading = short & (F.lower(line).isin(HEADINGS) | ((letters > 0) & (upper * 10 >= letters * 8)))
    kind = F.when(line.rlike(r"^[-*•]"), "bullet").when(line.rlike(r"@|https?://"), "contact").when(heading, "heading").otherwise("body")
    return rows.withColumn("kind", kind)


def search_queries(title: Column, level: Column, skills: Column, place: Column) -> Column:
    """Up to six distinct search phrases from a profile."""
    s = lambda i: F.coalesce(F.get(skills, F.lit(i)), F.lit(""))
    phrases = F.array(
        F.concat_ws(" ", title, place), F.concat_ws(" ", F.lower(level), title), F.concat_ws(" ", s(0), s(1), F.lit("developer")), F.concat_ws(" ", title, s(0))
    )
    return F.slice(distinct_ignoring_case(F.transform(phrases, lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))), 1, 6)


def matched_first(skills: Column, matched: Column) -> Column:
    """A stable partition: matched skills, then the rest."""
    return F.concat(F.filter(skills, lambda x: F.array_contains(matched, x)), F.filter(skills, lambda x: ~F.array_contains(matched, x)))


def skills_line(parts: dict[str, Column], every: bool = False) -> Column:
    """The line of skills of a tailored resume: those present and typed, and with ``every`` the suggestions as well."""
    line = F.array_union(parts["present"], parts["typed"])
    return F.array_join(F.array_union(line, parts["suggestions"]) if every else line, ", ")


def search_terms(position: Column, titles: Column, skills: Column) -> Column:
    """Up to six distinct short terms: parts of the position, two titles, four skills. Empty where there are none."""
    parts = F.split(F.coalesce(position, F.lit("")), r"[,\n;]+")
    return F.slice(distinct_ignoring_case(F.concat(parts, F.slice(titles, 1, 2), F.slice(skills, 1, 4))), 1, 6)


def longest_first(terms: Column) -> Column:
    """Longer terms first, so that none is found inside another; equal lengths keep their order."""
    placed = F.transform(terms, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda x: x["x"])


#: Words that are section titles, signs that begin a bullet, and words of a contact line (fixed values).
SECTIONS = [
    "summary", "objective", "profile", "about", "experience", "work experience", "employment", "professional experience", "education", "academic",
    "skills", "technical skills", "core competencies", "projects", "project", "certifications", "certificates", "courses", "achievements",
    "accomplishments", "awards", "publications", "languages", "interests", "hobbies", "contact", "references", "volunteer", "activities",
]
BULLETS = ["•", "◦", "▪", "‣", "·", "∙", "●", "○", "*", "-", "–", "—", "\uf0b7", "\uf0a7", "\uf06e", "\uf0d8", "\uf0fc"]
CONTACT = r"(?i)@|http|linkedin|github|\||\+?[0-9][0-9\s()\-]{7,}"
#: End of fixed values.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
LINE_WHITE = " \t\x0b\x0c\x1f\xa0\u3000"


def is_heading(line: Column) -> Column:
    """A section title: a known word, or at most five words and 40 letters, of whose letters four in five are capitals."""
    s = F.trim(F.rtrim(F.trim(line, F.lit(LINE_WHITE)), F.lit(":")), F.lit(LINE_WHITE))
    letters, capitals = (F.length(F.regexp_replace(s, p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    few = F.size(F.split(s, r"\s+")) <= 5
    return (s != "") & (F.length(s) <= 40) & (F.lower(s).isin(SECTIONS) | ((letters > 0) & few & (capitals * 5 >= letters * 4)))


def is_bullet(line: Column) -> Column:
    s = F.ltrim(line, F.lit(LINE_WHITE))
    return F.substring(s, 1, 1).isin(BULLETS) & ~s.startswith("--")


def blocks(text: Column, skills: Column | None = None, ats: bool = False) -> Column:
    """A resume's lines as an array of (kind, text), in order; blank lines are left out.

    The first line is the name, up to two contact lines may follow it (a heading or any other line ends them), then comes the
    line of skills under a title of its own where there is one, then headings, bullets and body. Null and empty texts have
    only the skills. One pass over the lines of a row: what a line is depends on two before it at most.
    """
    trimmed = lambda x: F.trim(x, F.lit(LINE_WHITE))
    whole = F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: trimmed(x) != "")
    block = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))

    def after_name(lines: Column, i: int) -> Column:
        line = F.get(lines, F.lit(i))
        return F.coalesce(line.rlike(CONTACT) & ~is_heading(line), F.lit(False))

    def kind_of(line: Column) -> Column:
        bullet = trimmed(F.substr(F.ltrim(line, F.lit(LINE_WHITE)), F.lit(2)))
        title = F.upper(F.rtrim(trimmed(line), F.lit(":")))
        return F.when(is_heading(line), block("heading", title)).when(is_bullet(line), block("bullet", bullet)).otherwise(block("body", trimmed(line)))

    def of(lines: Column) -> Column:
        contacts = F.when(~after_name(lines, 1), 0).when(~after_name(lines, 2), 1).otherwise(2)
        head = F.transform(F.slice(lines, 1, 1), lambda x: block("name", trimmed(x)))
        known = F.transform(F.slice(lines, F.lit(2), contacts), lambda x: block("contact", trimmed(x)))
        rest = F.transform(F.slice(lines, contacts + 2, F.greatest(F.size(lines), F.lit(1))), kind_of)
        line = F.coalesce(skills, F.lit("")) if skills is not None else F.lit("")
        title = F.lit("CORE COMPETENCIES" if ats else "KEY SKILLS FOR THIS ROLE")
        asked = F.filter(F.array(block("skillhead", title), block("skills", line)), lambda _: line != "")
        return F.concat(head, known, asked, rest)

    return named(whole, of)


def term_pattern(terms: list[str]) -> str:
    """Any of the terms, longer ones first, where no letter, digit, ``+`` or ``#`` (nor ``.`` before it) touches it; ASCII case aside."""
    alike = sorted(dict.fromkeys(terms), key=len, reverse=True)
    return r"(?i)(?<![A-Za-z0-9+#.])(?:" + "|".join(re.escape(t) for t in alike) + r")(?![A-Za-z0-9+#])"


def segments(text: Column, terms: list[str]) -> Column:
    """``text`` cut into an array of (text, bold), bold where a term stands; the parts join to the text. An empty text has none."""
    part = lambda t, bold: F.struct(t.alias("text"), F.lit(bold).alias("bold"))
    if not terms:
        return F.filter(F.array(part(F.coalesce(text, F.lit("")), False)), lambda x: x["text"] != "")
    pattern = term_pattern(terms)

    def cut(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(F.split(t, pattern, -1), hits, lambda a, b: F.array(part(F.coalesce(a, F.lit("")), False), part(F.coalesce(b, F.lit("")), True)))
        return F.filter(F.flatten(pairs), lambda x: x["text"] != "")

    return named(F.coalesce(text, F.lit("")), cut)


def matched_labels(job: Column, lexicon: Lexicon) -> Column:
    """Labels with an alias that touches no letter or digit in a job text, sorted; other signs are borders here."""
    low = F.lower(F.coalesce(job, F.lit("")))
    found = [F.when(low.rlike("|".join(rf"(?<![a-z0-9]){re.escape(a.strip().lower())}(?![a-z0-9])" for a in aliases)), F.lit(label)) for label, aliases in sorted(lexicon.items())]
    return F.array_compact(F.array(*found, F.lit(None).cast("string")))


def summary(matched: Column, priority: list[str], default: list[str], short: dict[str, str], template: str) -> Column:
    """``template`` with its ``{stack}``: the matched skills in order of priority, by short names, at most five.

    Fewer than three are topped up with the default ones. They read "a", "a, and b", "a, b, and c".
    """
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    before, after = template.split("{stack}")
    names = F.create_map(*[F.lit(x) for pair in short.items() for x in pair]) if short else F.create_map().cast("map<string,string>")

    def said(lead: Column) -> Column:
        all_of = F.when(F.size(lead) < 3, F.concat(lead, F.array_except(strings(list(dict.fromkeys(default))), lead))).otherwise(lead)
        shown = F.slice(F.transform(all_of, lambda x: F.coalesce(F.try_element_at(names, x), x)), 1, 5)

        def joined(parts: Column) -> Column:
            n = F.size(parts)
            return F.when(n > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(", and "), F.get(parts, n - 1))).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))

        return named(shown, joined)

    return F.concat(F.lit(before), named(F.filter(strings(priority), lambda x: F.array_contains(matched, x)), said), F.lit(after))


def cover_note(title: Column, company: Column, matched: Column, profile: dict[str, str], template: str) -> Column:
    """``template`` with its names filled: {role}, {company} and {skills} by the row, the others by ``profile``. Blank ones read as stated."""
    trimmed = lambda c, default: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c)).otherwise(default)
    skills = F.when(F.coalesce(F.size(matched), F.lit(0)) > 0, F.array_join(F.slice(matched, 1, 5), ", ")).otherwise("backend and API development")
    given = {"role": trimmed(title, "this role"), "company": trimmed(company, "your team"), "skills": skills}
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else given[p] if p in given else F.lit(profile[p]) for i, p in enumerate(parts)])
