"""Postings from landed payloads (JSON and RSS text of job boards). No network is used.

Each parser takes rows (ord, payload) and gives postings (``POSTING``). JSON is read as VARIANT, as one field may be a text, a
number, a list or missing from row to row: a payload that cannot be read gives no rows, and a field of another kind than
expected never ends a query. ``hours`` and ``as_of`` keep what is young enough (unknown dates are); 0 hours keep all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once
from talus.functions.references import unescaped
from talus.functions.text import contains_any, keyword_match, strip_html
from talus.operators.filters import age_within, level_fits

#: Words of software roles (fixed values).
DEVELOPER = [
    "backend", "back end", "back-end", "frontend", "front end", "full stack", "fullstack", "software", "developer", "engineer",
    "sde", "node", "nestjs", "java", "python", "golang", " go ", "react", "angular", "spring", "fastapi", "api", "devops",
    "typescript", "javascript", "php", "ruby", ".net",
]
#: Words of the seniorities that are kept, and of those that are not (fixed values).
OPEN_TO = ["junior", "mid", "entry", "associate"]
CLOSED_TO = ["senior", "lead", "principal", "staff", "director"]
#: Comments of a thread that are read, letters of a title and of a description (fixed values).
COMMENTS, TITLE, DESCRIPTION = 80, 140, 1500
NOWHERE = "—"
#: End of fixed values.
POSTING = ["ord", "title", "company", "location", "site", "date_posted", "is_remote", "job_url", "description"]
#: Seconds from the year 1 to the year 9999.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def item_ord() -> Column:
    """Payload, then place in it, in one ordinal: a list has under 2**31 items, so payloads up to 2**32 do not collide."""
    return (F.shiftleft(F.col("ord").cast("long"), 31) + F.col("n")).alias("ord")


def field(j: Column, path: str) -> Column:
    return F.try_variant_get(j, f"$.{path}", "variant")


def as_text(v: Column) -> Column:
    """A value as text, null for JSON's null; lists and objects are their JSON."""
    return F.try_variant_get(v, "$", "string")


def filled(v: Column) -> Column:
    """The value as text where it is not empty: no null, "", 0, false, [] or {}."""
    empty = F.when(F.schema_of_variant(v) == "STRING", as_text(v) == "").otherwise(as_text(v).isin("0", "0.0", "false", "[]", "{}"))
    return F.when(~empty, as_text(v))


def first_filled(j: Column, *paths: str) -> Column:
    """The first of some fields that is not empty, as text; "" without one."""
    return F.coalesce(*[filled(field(j, p)) for p in paths], F.lit(""))


def texts(v: Column) -> Column:
    """A list as texts, a single text as a list of one; empty otherwise."""
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), as_text)
    one = F.when(F.schema_of_variant(v) == "STRING", F.filter(F.array(as_text(v)), lambda t: t != ""))
    return F.coalesce(many, one, F.array().cast("array<string>"))


def items(payloads: DataFrame, lists: list[str], *whole: str, **fields: str) -> DataFrame:
    """One row for each object of the first list of a payload that is not empty ("": the payload itself is the list).

    ``fields``: columns and the paths, parted by "|", whose first filled one they hold as text; ``whole``: columns that stay
    VARIANT. Each is read once a row.
    """
    parsed = payloads.select("ord", F.try_parse_json("payload").alias("v"))
    found = [F.try_variant_get("v", f"$.{name}" if name else "$", "array<variant>") for name in lists]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])
    rows = parsed.select("ord", F.posexplode(chosen).alias("n", "j")).where(F.schema_of_variant("j").startswith("OBJECT"))
    j = F.col("j")
    return computed_once(rows.select(item_ord(), "n", *[field(j, w).alias(w) for w in whole], *[first_filled(j, *p.split("|")).alias(c) for c, p in fields.items()]))


def seconds(t: Column, per_second: int = 1) -> Column:
    """Seconds since 1970 of a text that is a number of them or of parts of them, null otherwise or where no date has it."""
    n = F.floor(F.when(F.trim(t).rlike(r"^[+-]?[0-9]{1,15}(?:\.[0-9]{1,10})?$"), F.trim(t).try_cast("decimal(30,10)").cast("long")) / per_second)
    return F.when(n.between(FIRST_SECOND, LAST_SECOND), n)


def iso(s: Column) -> Column:
    """Seconds as a UTC time in ISO form, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(s / 86400).cast("int"))
    rest = F.pmod(s, F.lit(86400))
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))


def _posting(rows: DataFrame, hours: int, as_of: Column | None, date: Column, **columns: Column) -> DataFrame:
    """Postings of rows whose ``date`` is young enough; the columns are given by name."""
    young = rows.where(age_within(date, as_of, hours)) if hours else rows
    return young.select("ord", *[F.coalesce(columns[c], F.lit(False) if c == "is_remote" else F.lit("")).alias(c) for c in POSTING[1:]])


def _words(keywords: list[str]) -> Column:
    return F.array(*map(F.lit, keywords)).cast("array<string>")


def _day(c: str) -> Column:
    return F.substring(c, 1, 10)


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def remotive(payloads: DataFrame, hours: int = 0, as_of: Column | None = None) -> DataFrame:
    r = items(payloads, ["jobs"], title="title", company="company_name", place="candidate_required_location", date="publication_date", url="url", about="description")
    return _posting(
        r, hours, as_of, F.col("date"), title=F.col("title"), company=F.col("company"), location=_or("place", "Remote"), site=F.lit("remotive"),
        date_posted=_day("date"), is_remote=F.lit(True), job_url=F.col("url"), description=strip_html(F.col("about")),
    )


def remoteok(payloads: DataFrame, hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items with a position and a word of software roles in it or in the tags."""
    r = items(payloads, [""], "tags", title="position", company="company", place="location", date="date", url="url|apply_url", about="description")
    r = r.where((F.col("title") != "") & contains_any(F.lower(F.concat_ws(" ", "title", F.array_join(texts(F.col("tags")), " "))), DEVELOPER))
    return _posting(
        r, hours, as_of, F.col("date"), title=F.col("title"), company=F.col("company"), location=_or("place", "Remote"), site=F.lit("remoteok"),
        date_posted=_day("date"), is_remote=F.lit(True), job_url=F.col("url"), description=strip_html(F.col("about")),
    )


def jobicy(payloads: DataFrame, hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items with a url, the first young one of each url over all payloads."""
    r = items(payloads, ["jobs"], title="jobTitle", company="companyName", place="jobGeo", date="pubDate|date", url="url", about="jobDescription|jobExcerpt")
    rows = _posting(
        r.where("url <> ''"), hours, as_of, F.col("date"), title=F.col("title"), company=F.col("company"), location=_or("place", "Remote"), site=F.lit("jobicy"),
        date_posted=_day("date"), is_remote=F.lit(True), job_url=F.col("url"), description=F.col("about"),
    )
    rest = [c for c in POSTING if c not in ("ord", "job_url")]
    best = rows.groupBy("job_url").agg(F.min("ord").alias("ord"), F.min_by(F.struct(*rest), "ord").alias("r"))
    return best.select(*[c if c in ("ord", "job_url") else f"r.{c}" for c in POSTING]).withColumn("description", strip_html(F.col("description")))


def arbeitnow(payloads: DataFrame, hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items with a word of software roles in title or tags; their times are seconds."""
    r = items(payloads, ["data"], "tags", title="title", company="company_name", place="location", date="created_at", url="url", remote="remote", about="description")
    r = r.where(contains_any(F.lower(F.concat_ws(" ", "title", F.array_join(texts(F.col("tags")), " "))), DEVELOPER))
    r = r.withColumn("at", F.coalesce(iso(seconds(F.col("date"))), F.lit("")))
    remote = F.col("remote") != ""
    return _posting(
        r, hours, as_of, F.col("at"), title=F.col("title"), company=F.col("company"), location=F.coalesce(F.nullif("place", F.lit("")), F.when(remote, "Remote")), site=F.lit("arbeitnow"),
        date_posted=_day("at"), is_remote=remote, job_url=F.col("url"), description=strip_html(F.col("about")),
    )


def himalayas(payloads: DataFrame, hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items with a url and a word of software roles in the title that are not for seniors only.

    Seniority is a text or a list, the date seconds (also as text) or ISO, places a list; each may be null or missing.
    """
    r = items(
        payloads, ["jobs", "data"], "seniority", "locationRestrictions", title="title", company="companyName|company_name", date="pubDate|publishedDate|date",
        url="applicationLink|guid|url", about="description|excerpt",
    )
    level = F.lower(F.array_join(texts(F.col("seniority")), " "))
    r = r.where(contains_any(F.lower("title"), DEVELOPER) & (F.col("url") != "")).withColumns({"level": level, "at": F.coalesce(iso(seconds(F.col("date"))), F.col("date"))})
    r = computed_once(r).where((F.col("level") == "") | contains_any(F.col("level"), OPEN_TO) | ~contains_any(F.col("level"), CLOSED_TO))
    listed = F.transform(F.try_variant_get("locationRestrictions", "$", "array<variant>"), as_text)
    return _posting(
        r, hours, as_of, F.col("at"), title=F.col("title"), company=F.col("company"), location=F.when(F.size(listed) > 0, F.array_join(listed, ", ", "None")).otherwise("Remote"), site=F.lit("himalayas"),
        date_posted=_day("at"), is_remote=F.lit(True), job_url=F.col("url"), description=strip_html(F.col("about")),
    )


def _says_remote() -> Column:
    return F.contains(F.lower(F.concat_ws(" ", "title", "place")), F.lit("remote"))


def greenhouse(payloads: DataFrame, company: str, keywords: list[str], hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items whose title has a keyword."""
    r = items(payloads, ["jobs"], title="title", place="location.name", date="updated_at", url="absolute_url").where(keyword_match(F.col("title"), _words(keywords)))
    return _posting(
        r, hours, as_of, F.col("date"), title=F.col("title"), company=F.lit(company), location=_or("place", NOWHERE), site=F.lit(f"{company} careers (Greenhouse)"),
        date_posted=_day("date"), is_remote=_says_remote(), job_url=F.col("url"), description=F.trim(F.concat("title", F.lit(f" at {company}. "), "place")),
    )


def lever(payloads: DataFrame, company: str, keywords: list[str], hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items whose title or opening has a keyword; their times are milliseconds."""
    r = items(payloads, [""], title="text", place="categories.location", team="categories.team", date="createdAt", url="hostedUrl", plain="descriptionPlain")
    r = r.withColumn("about", F.substring("plain", 1, DESCRIPTION)).where(keyword_match(F.concat_ws(" ", "title", "about"), _words(keywords)))
    r = r.withColumn("at", F.coalesce(iso(seconds(F.col("date"), 1000)), F.lit("")))
    return _posting(
        r, hours, as_of, F.col("at"), title=F.col("title"), company=F.lit(company), location=F.coalesce(F.nullif("place", F.lit("")), _or("team", NOWHERE)), site=F.lit(f"{company} careers (Lever)"),
        date_posted=_day("at"), is_remote=_says_remote(), job_url=F.col("url"), description=F.coalesce(F.nullif("about", F.lit("")), F.concat("title", F.lit(f" at {company}"))),
    )


def ashby(payloads: DataFrame, company: str, slug: str, keywords: list[str], hours: int = 0, as_of: Column | None = None) -> DataFrame:
    """Items whose title or opening has a keyword, and that have a url: their own, that to apply, or one made of their id."""
    r = items(payloads, ["jobs"], title="title", place="location", date="publishedAt", own="jobUrl|applyUrl", id="id", remote="isRemote", plain="descriptionPlain")
    r = r.withColumn("about", F.substring("plain", 1, DESCRIPTION)).where(keyword_match(F.concat_ws(" ", "title", "about"), _words(keywords)) & ((F.col("own") != "") | (F.col("id") != "")))
    url = F.coalesce(F.nullif("own", F.lit("")), F.concat(F.lit(f"https://jobs.ashbyhq.com/{slug}/"), "id"))
    return _posting(
        r, hours, as_of, F.col("date"), title=F.col("title"), company=F.lit(company), location=_or("place", NOWHERE), site=F.lit(f"{company} careers (Ashby)"), date_posted=_day("date"),
        is_remote=(F.col("remote") != "") | _says_remote(), job_url=url, description=F.coalesce(F.nullif("about", F.lit("")), F.concat("title", F.lit(f" at {company}"))),
    )


def hackernews(payloads: DataFrame, keywords: list[str]) -> DataFrame:
    """The first comments of a thread that have a keyword: the first line is the title, the first link the url."""
    r = items(payloads, ["children"], raw="text", id="id").where(F.col("n") < COMMENTS)
    link = F.regexp_extract("raw", 'href="([^"]+)"', 1)
    own = F.concat(F.lit("https://news.ycombinator.com/item?id="), _or("id", "None"))
    head = strip_html(F.get(F.split("raw", r"\n|<p>", 2), F.lit(0)))
    r = computed_once(r.select("ord", strip_html(F.col("raw")).alias("said"), head.alias("head"), F.when(link != "", unescaped(link)).otherwise(own).alias("url")))
    r = r.where((F.col("said") != "") & keyword_match(F.col("said"), _words(keywords)))
    return _posting(
        r, 0, None, F.lit(""), title=F.coalesce(F.nullif(F.substring("head", 1, TITLE), F.lit("")), F.substring("said", 1, TITLE)), company=F.lit("(HN Who's Hiring)"), location=F.lit(NOWHERE), site=F.lit("Hacker News"),
        date_posted=F.lit(""), is_remote=F.contains(F.lower("said"), F.lit("remote")), job_url=F.col("url"), description=F.substring("said", 1, DESCRIPTION),
    )


def weworkremotely(payloads: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """An RSS payload; a title reads "company: role". A payload without whole items gives no rows."""
    names = ("title", "link", "pubDate", "region", "category", "description")
    blocks = F.regexp_extract_all("payload", F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1))
    r = payloads.select("ord", F.posexplode(blocks).alias("n", "block"))

    def inner(tag: str) -> Column:
        got = F.regexp_extract("block", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        plain = F.regexp_extract(got, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
        return F.when(plain != "", plain).otherwise(unescaped(got)).alias(tag)

    r = computed_once(r.select(item_ord(), *map(inner, names)))
    r = r.where(keyword_match(F.concat_ws(" ", "title", "category"), _words(keywords or [])))
    split = F.instr("title", ":") > 0
    role = F.when(split, F.coalesce(F.nullif(F.trim(F.expr("substring(title, instr(title, ':') + 1)")), F.lit("")), F.col("title"))).otherwise(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("title")))
    company = F.trim(F.substring_index("title", ":", 1))
    return _posting(
        r, 0, None, F.lit(""), title=role, company=F.coalesce(F.nullif(company, F.lit("")), F.lit(NOWHERE)), location=F.coalesce(F.nullif("region", F.lit("")), F.lit("Remote")), site=F.lit("WeWorkRemotely"),
        date_posted=F.substring("pubDate", 1, 16), is_remote=F.lit(True), job_url=F.col("link"), description=F.coalesce(F.nullif(F.substring(strip_html(F.col("description")), 1, DESCRIPTION), F.lit("")), role),
    )


def fan_in(sources: list[DataFrame], level: str = "", first_only: bool = True) -> DataFrame:
    """All postings with a url whose level fits, by (rank of the source, place in it), the first of each url.

    Sources may lack columns. The order does not depend on which source was read first, nor on partitions.
    """
    ranked = [s.withColumn("rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    rows = rows.where((F.coalesce("job_url", F.lit("")) != "") & level_fits(F.col("title"), level))
    if not first_only:
        return rows
    order = F.struct("rank", "ord")
    rest = [c for c in rows.columns if c != "job_url"]
    return rows.groupBy("job_url").agg(F.min_by(F.struct(*rest), order).alias("r")).select(*[c if c == "job_url" else f"r.{c}" for c in rows.columns])


def scanned(scans: list[tuple[str, DataFrame]]) -> DataFrame:
    """Scans of boards by search term as one table: ``search_term`` and ``rank`` tell the scan, the first row of each url stays.

    Scans may lack columns; texts that are missing or null are empty. All rows without a url count as one url, so one stays.
    """
    ranked = [s.withColumns({"search_term": F.lit(term), "rank": F.lit(i)}) for i, (term, s) in enumerate(scans)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    rows = rows.fillna("").withColumn("job_url", F.coalesce("job_url", F.lit("")))
    rest = [c for c in rows.columns if c != "job_url"]
    best = rows.groupBy("job_url").agg(F.min_by(F.struct(*rest), F.struct("rank", "ord")).alias("r"))
    return best.select(*[c if c == "job_url" else f"r.{c}" for c in rows.columns])
