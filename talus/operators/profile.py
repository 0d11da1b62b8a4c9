"""Candidate profiles: from resumes and typed inputs, from saved profiles, and after edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once, named
from talus.functions.text import EMAIL, distinct_ignoring_case
from talus.operators.lexicon import Lexicon, ordered_tags
from talus.operators.resume import LINE_END, LINE_WHITE, split_skills
from talus.operators.scoring import level_of

# Needles and roles, in the order in which roles are named; those of languages count where no role is met.
ROLES = [
    ("backend", "Backend Developer"), ("back-end", "Backend Developer"), ("back end", "Backend Developer"), ("frontend", "Frontend Developer"),
    ("front-end", "Frontend Developer"), ("front end", "Frontend Developer"), ("full stack", "Full Stack Developer"), ("fullstack", "Full Stack Developer"),
    ("data engineer", "Data Engineer"), ("data scien", "Data Scientist"), ("data analyst", "Data Analyst"), ("devops", "DevOps Engineer"),
    ("machine learning", "Machine Learning Engineer"), ("ml engineer", "Machine Learning Engineer"), ("android", "Android Developer"), ("ios ", "iOS Developer"),
    ("mobile", "Mobile Developer"), ("qa ", "QA Engineer"), ("test engineer", "QA Engineer"), ("cloud engineer", "Cloud Engineer"), ("site reliability", "SRE"),
    ("software engineer", "Software Engineer"), ("software developer", "Software Developer"), ("sde 1", "Software Engineer"), ("sde-1", "Software Engineer"),
    ("sde i", "Software Engineer"), ("sde1", "Software Engineer"), ("langchain", "AI/ML Engineer"), ("langgraph", "AI/ML Engineer"), ("agentic", "AI/ML Engineer"),
    ("ai engineer", "AI/ML Engineer"),
]
LANGUAGES = [
    ("nestjs", "Node.js Developer"), ("node", "Node.js Developer"), ("django", "Python Developer"), ("fastapi", "Python Developer"), ("python", "Python Developer"),
    ("spring", "Java Developer"), ("java", "Java Developer"), ("react", "React Developer"), ("angular", "Angular Developer"), ("golang", "Go Developer"),
    (".net", ".NET Developer"), ("php", "PHP Developer"),
]
DOMAINS = {
    "fintech": ["fintech", "payments", "banking", "trading", "lending", "insurance", "insurtech", "wealth"],
    "healthcare": ["healthcare", "health care", "medical", "clinical", "hospital", "pharma", "healthtech", "biotech"],
    "e-commerce": ["e-commerce", "ecommerce", "retail", "marketplace", "shopping", "d2c"],
    "edtech": ["edtech", "e-learning", "learning platform", "education technology"],
    "logistics": ["logistics", "supply chain", "delivery", "shipping", "fleet", "mobility"],
    "gaming": ["gaming", "game development", "gamedev", "game studio"],
    "social": ["social media", "social network", "content platform", "creator"],
    "travel": ["travel", "hospitality", "booking", "tourism", "airline"],
    "saas": ["saas", "b2b", "enterprise software"],
    "cybersecurity": ["cybersecurity", "infosec", "security operations", "threat"],
    "ai/ml": ["ai platform", "ml platform", "computer vision", "nlp", "generative ai"],
}
#: Degrees and certificates as words, a firm's name with its form, a telephone number, years of experience.
DEGREE = r"(?i)(?<![A-Za-z0-9_])(?:b\.?tech|b\.?e\.?|bachelor|b\.?sc|b\.?c\.?a|m\.?tech|m\.?sc|m\.?c\.?a|master|mba|ph\.?d|b\.?com|diploma)(?![A-Za-z0-9_])"
CERTIFICATE = r"(?i)(?<![A-Za-z0-9_])(?:certif|certificate|certification|certified)(?![A-Za-z0-9_])"
FIRM = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9&.'\-]+(?: [A-Z][A-Za-z0-9&.'\-]+){0,3} +(?:Inc|LLC|Ltd|Pvt\.?(?: Ltd)?|Limited|Technologies|Labs|Corp|Consulting|GmbH|Systems)(?![A-Za-z0-9_])"
TELEPHONE = r"(?<![0-9])(\+?[0-9][0-9\s\-()]{7,}[0-9])(?![0-9])"
EXPERIENCE = r"(?i)([0-9]{1,2})\s*\+?\s*years?(?![A-Za-z0-9_])"
#: Letters of an education and a certificate, entries of a list, queries (at most).
EDUCATION, CERTIFICATE_LETTERS, ENTRIES, QUERIES = 160, 120, 6, 6
# End of fixed values.
STRINGS = "array<string>"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast(STRINGS)


def _stripped(c: Column) -> Column:
    return F.trim(c, F.lit(LINE_WHITE + "\r\n"))


def _named_by(low: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(needle)), F.lit(role)) for needle, role in pairs])))


def titles_in(text: Column) -> Column:
    """Roles that a text names, each once, in the order of the table; without any, those of its languages."""

    def of(low: Column) -> Column:
        return named(_named_by(low, ROLES), lambda found: F.when(F.size(found) > 0, found).otherwise(_named_by(low, LANGUAGES)))

    return named(F.lower(F.coalesce(text, F.lit(""))), of)


def domains_in(text: Column) -> Column:
    def of(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(sum((F.contains(low, F.lit(n)).cast("int") for n in needles), F.lit(0)) > 0, F.lit(d)) for d, needles in DOMAINS.items()]))

    return named(F.lower(F.coalesce(text, F.lit(""))), of)


def stated_experience(text: Column) -> Column:
    """The first "N years" of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), EXPERIENCE, 1).try_cast("int"), F.lit(0))


def name_of(lines: Column) -> Column:
    """The first line that is not blank if it looks like a name: up to four words, each with a capital, no digit, address or link."""

    def of(s: Column) -> Column:
        words = F.split(s, r"\s+")
        capital = F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
        fits = ~s.rlike(r"(?i)@|http|\p{Nd}") & (F.size(words) <= 4) & (F.length(s) <= 40) & capital
        return F.when(fits, s).otherwise("")

    return F.coalesce(named(F.get(F.filter(F.transform(lines, _stripped), lambda x: x != ""), F.lit(0)), lambda s: F.when(s.isNotNull(), of(s))), F.lit(""))


def facts(text: Column) -> Column:
    """(name, email, phone, education, certifications, companies, domains, years) that a resume states."""

    def of(t: Column) -> Column:
        def by_line(lines: Column) -> Column:
            clean = F.transform(lines, _stripped)
            education = F.get(F.filter(clean, lambda x: x.rlike(DEGREE)), F.lit(0))
            certificates = F.filter(clean, lambda x: x.rlike(CERTIFICATE) & (F.length(x) <= CERTIFICATE_LETTERS))
            firms = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, FIRM, 0))), lambda x: F.length(x) > 3)
            return F.struct(
                name_of(lines).alias("name"), F.coalesce(F.substring(education, 1, EDUCATION), F.lit("")).alias("education"), F.slice(certificates, 1, ENTRIES).alias("certifications"),
                F.slice(distinct_ignoring_case(firms), 1, ENTRIES).alias("companies"),
            )

        about = named(F.split(t, LINE_END), by_line)
        return F.struct(about.alias("lines"), F.regexp_extract(t, EMAIL, 0).alias("email"), F.trim(F.regexp_extract(t, TELEPHONE, 1)).alias("phone"), domains_in(t).alias("domains"), stated_experience(t).alias("years"))

    return named(F.coalesce(text, F.lit("")), of)


def typed_skills(typed: Column, lexicon: Lexicon) -> Column:
    """Labels that typed skills name, in order, then the parts that are none of them, each once whatever its case."""
    parts = F.filter(F.transform(F.split(F.coalesce(typed, F.lit("")), r"[,\n;|]+"), _stripped), lambda x: x != "")
    return distinct_ignoring_case(F.concat(ordered_tags(typed, lexicon), parts))


def board_queries(title: Column, titles: Column, primary: Column, added: Column, default: list[str]) -> Column:
    """Up to six distinct phrases to search boards with: title and skills, other titles, skills alone, title and typed skills.

    Parts that are missing leave out their phrase; without any the default ones stand.
    """

    def of(p: Column) -> Column:
        joined = lambda items, n: F.array_join(F.slice(items, 1, n), " ")
        current = _stripped(F.coalesce(F.nullif(p["title"], F.lit("")), F.get(p["titles"], F.lit(0)), F.lit("")))
        phrases = F.concat(
            F.array(F.when(current != "", F.concat_ws(" ", current, joined(p["primary"], 3)))),
            F.transform(F.slice(p["titles"], 1, 2), lambda t: F.concat_ws(" ", t, joined(p["primary"], 2))),
            F.array(F.when(F.size(p["primary"]) > 0, joined(p["primary"], 4)), F.when(F.size(p["added"]) > 0, F.concat_ws(" ", current, joined(p["added"], 3)))),
        )
        clean = distinct_ignoring_case(F.transform(F.array_compact(phrases), lambda x: F.regexp_replace(x, r"\s+", " ")))
        return named(clean, lambda c: F.slice(F.when(F.size(c) > 0, c).otherwise(_strings(default)), 1, QUERIES))

    filled = F.filter(F.coalesce(titles, F.array().cast(STRINGS)), lambda t: t != "")
    empty = F.array().cast(STRINGS)
    return named(F.struct(F.coalesce(title, F.lit("")).alias("title"), filled.alias("titles"), F.coalesce(primary, empty).alias("primary"), F.coalesce(added, empty).alias("added")), of)


def from_resume(df: DataFrame, lexicon: Lexicon, default: list[str], home: str = "") -> DataFrame:
    """Adds the profile's columns to rows of (resume, skills_text, position, years, place, remote, wanted_companies, least_pay).

    Skills of the resume are primary or secondary; typed ones are added, and jobs are matched against primary and added ones.
    Stated years give way to given ones above 0. Null inputs are empty. The resume is read once for each kind of fact.
    """
    empty = F.lit("")
    text = {c: F.coalesce(c, empty) for c in ("resume", "skills_text", "position", "place", "wanted_companies")}
    whole = F.concat(text["position"], F.lit("\n"), text["resume"])
    parts = {
        "__facts": facts(F.col("resume")), "__split": split_skills(F.col("resume"), lexicon), "__ordered": ordered_tags(F.col("resume"), lexicon),
        "job_titles": titles_in(whole), "user_added_skills": typed_skills(F.col("skills_text"), lexicon),
    }
    rows = computed_once(df.withColumns(parts))
    of = lambda kind: F.filter("__ordered", lambda x: F.array_contains(F.col("__split")[kind], x))
    given = F.coalesce("years", F.lit(0))
    place = F.coalesce(F.nullif(_stripped(text["place"]), empty), F.lit(home))
    first = F.when(_stripped(text["position"]) != "", _stripped(F.substring_index(text["position"], ",", 1))).otherwise(F.coalesce(F.get("job_titles", F.lit(0)), empty))
    rows = rows.withColumns({
        "primary_skills": of("primary"), "secondary_skills": of("secondary"), "experience_years": F.when(given != 0, given).otherwise(F.col("__facts")["years"]).cast("int"), "current_title": first,
        "name": F.col("__facts")["lines"]["name"], "email": F.col("__facts")["email"], "phone": F.col("__facts")["phone"], "education": F.col("__facts")["lines"]["education"],
        "certifications": F.col("__facts")["lines"]["certifications"], "companies_worked_at": F.col("__facts")["lines"]["companies"], "domains": F.col("__facts")["domains"],
        "preferred_companies": F.filter(F.transform(F.split(text["wanted_companies"], r"[,\n;]+"), _stripped), lambda x: x != ""),
        "location": place, "location_preference": place, "remote_preference": F.when(F.coalesce("remote", F.lit(False)), "remote").otherwise("any"), "min_salary": F.coalesce("least_pay", F.lit(0)),
    })
    rows = computed_once(rows.drop("__facts", "__split", "__ordered"))
    return _derived(rows, default)


def _derived(rows: DataFrame, default: list[str]) -> DataFrame:
    """What follows from the other columns of a profile."""
    searchable = distinct_ignoring_case(F.concat("primary_skills", "user_added_skills"))
    years = F.col("experience_years")
    return rows.withColumns({
        "target_titles": F.col("job_titles"), "experience_level": level_of(years), "max_experience_to_search": years + 1, "all_searchable_skills": searchable, "keywords": searchable,
        "search_queries": board_queries(F.col("current_title"), F.col("job_titles"), F.col("primary_skills"), F.col("user_added_skills"), default),
    })


def _whole_number(c: Column) -> Column:
    """A text that is a whole number, else 0."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(c).try_cast("int")).otherwise(0)


def after_edits(edited: DataFrame, default: list[str], home: str = "") -> DataFrame:
    """Edited profiles with what follows from them made anew, whatever was sent.

    Skills and titles lose blanks and repeats (the first spelling stays), years and pay (texts) that are no whole numbers are
    0, a missing title is the first of the titles, a missing place is home. Missing columns count as null.
    """
    have, empty = set(edited.columns), F.array().cast(STRINGS)
    text = lambda c: F.coalesce(c, F.lit("")) if c in have else F.lit("")
    listed = lambda c: distinct_ignoring_case(F.coalesce(c, empty)) if c in have else empty
    kept = lambda c: F.coalesce(c, empty) if c in have else empty
    titles = F.when(F.size(kept("target_titles")) > 0, kept("target_titles")).otherwise(kept("job_titles"))
    place = F.coalesce(F.nullif(text("location"), F.lit("")), F.nullif(text("location_preference"), F.lit("")), F.lit(home))
    rows = edited.withColumns({
        **{c: listed(c) for c in ("primary_skills", "secondary_skills", "user_added_skills")}, "job_titles": distinct_ignoring_case(titles),
        **{c: kept(c) for c in ("domains", "companies_worked_at", "preferred_companies", "certifications")}, **{c: text(c) for c in ("name", "email", "phone", "education")},
        "experience_years": _whole_number(text("experience_years")), "min_salary": _whole_number(text("min_salary")), "location": place, "location_preference": place,
        "remote_preference": F.coalesce(F.col("remote_preference"), F.lit("any")) if "remote_preference" in have else F.lit("any"),
    })
    rows = computed_once(rows)
    title = F.when(_stripped(text("current_title")) != "", text("current_title")).otherwise(F.coalesce(F.get("job_titles", F.lit(0)), F.lit("")))
    return _derived(computed_once(rows.withColumn("current_title", title)), default)


def with_edits(profiles: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    """Profiles with what was typed over them: (id, titles, skills, added: comma lists; years, remote: texts), null where nothing was typed.

    An emptied list is empty; years that do not begin with a number are 0. Profiles without edits stay. One row of edits for
    each id. ``after_edits`` makes anew what follows.
    """
    typed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    over = edits.select(id_col, *[F.col(c).alias(f"__{c}") for c in ("titles", "skills", "added", "years", "remote")])
    years = F.coalesce(F.regexp_extract("__years", r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0)).cast("string")
    new = {"target_titles": typed("__titles"), "job_titles": typed("__titles"), "primary_skills": typed("__skills"), "user_added_skills": typed("__added"), "experience_years": years, "remote_preference": F.col("__remote")}
    source = {"target_titles": "__titles", "job_titles": "__titles", "primary_skills": "__skills", "user_added_skills": "__added", "experience_years": "__years", "remote_preference": "__remote"}
    rows = profiles.join(over, id_col, "left")
    return rows.withColumns({c: F.when(F.col(source[c]).isNotNull(), v).otherwise(F.col(c).cast("string") if c == "experience_years" else F.col(c)) for c, v in new.items()}).drop(*over.columns[1:])


SAVED = "NAME string, SUMMARY_TEMPLATE string, DEFAULT_STACK array<string>, SKILLS map<string, array<string>>, EXPERIENCE array<struct<company:string, title:string, dates:string, bullets:array<string>>>"


def earliest_start(dates: Column) -> Column:
    """The first day of the earliest month that entries like "Jan 2020 - now" begin with; null without any."""
    month = F.lower(F.substring(F.regexp_extract(dates, r"^([A-Za-z]+)\s+[0-9]{4}", 1), 1, 3))
    year = F.regexp_extract(dates, r"^[A-Za-z]+\s+([0-9]{4})", 1).try_cast("int")
    place = F.array_position(_strings(MONTHS), month)
    return F.when((place > 0) & (year > 0), F.make_date(year, place.cast("int"), F.lit(1)))


def from_saved(saved: DataFrame, lexicon: Lexicon, as_of: Column, default: list[str], home: str = "") -> DataFrame:
    """Profiles of saved ones (``payload``: JSON), through ``from_resume``; columns besides the payload stay.

    Skills of all categories lose their parentheses and repeats; titles are distinct. Years are those that the summary states,
    else whole ones (of 365 days) since the earliest start, at least 1, else 2. Broken payloads are empty profiles.
    """
    rows = saved.withColumn("p", F.from_json("payload", SAVED)).drop("payload")
    empty, none = F.array().cast(STRINGS), F.lit("")
    jobs = F.coalesce("p.EXPERIENCE", F.array().cast("array<struct<company:string, title:string, dates:string, bullets:array<string>>>"))
    groups = F.transform(F.map_values(F.coalesce("p.SKILLS", F.create_map().cast("map<string, array<string>>"))), lambda g: F.coalesce(g, empty))
    bare = F.transform(F.flatten(groups), lambda s: F.regexp_replace(F.coalesce(s, none), r"\s*\(.*?\)\s*", " "))
    titles = F.array_distinct(F.filter(F.transform(jobs, lambda j: F.coalesce(j["title"], none)), lambda t: t != ""))
    summary = F.replace(F.coalesce("p.SUMMARY_TEMPLATE", none), F.lit("{stack}"), F.array_join(F.coalesce("p.DEFAULT_STACK", empty), ", "))
    start = F.array_min(F.transform(jobs, lambda j: earliest_start(F.coalesce(j["dates"], none))))
    lines = F.transform(jobs, lambda j: F.concat(F.array(F.concat(F.coalesce(j["dates"], none), F.lit(" — "), F.coalesce(j["title"], none), F.lit(" at "), F.coalesce(j["company"], none))), F.coalesce(j["bullets"], empty)))
    rows = computed_once(rows.select(*[c for c in rows.columns if c != "p"], F.coalesce("p.NAME", none).alias("__name"), summary.alias("__summary"), distinct_ignoring_case(bare).alias("__skills"), titles.alias("__titles"), start.alias("__start"), F.flatten(lines).alias("__lines")))
    counted = F.when(F.col("__start").isNotNull(), F.greatest(F.lit(1), F.floor(F.datediff(as_of, "__start") / 365).cast("int"))).otherwise(2)
    stated = stated_experience(F.col("__summary"))
    text = F.array_join(F.concat(F.array("__name", "__summary"), "__lines"), "\n")
    inputs = rows.withColumns({
        "resume": text, "skills_text": F.array_join("__skills", ", "), "position": F.array_join("__titles", ", "), "years": F.when(stated != 0, stated).otherwise(counted), "place": none, "remote": F.lit(False),
        "wanted_companies": none, "least_pay": F.lit(0),
    })
    return from_resume(computed_once(inputs).drop("__name", "__summary", "__skills", "__titles", "__start", "__lines"), lexicon, default, home)
