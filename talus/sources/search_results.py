"""Postings from landed results of web searches: rows (ord, term, payload), a JSON text ``{results: [{url, title, content}]}`` for each term.

A url counts once, where it is met first by (ord, place in the payload) among the results that fit. Payloads that cannot be
read give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once, named
from talus.functions.text import contains_any, keyword_match
from talus.operators.filters import is_posting_url
from talus.sources.payloads import DESCRIPTION, NOWHERE, POSTING, first_filled, item_ord

#: Places of postings, of boards, and of posts; what parts a title; terms of a search of boards and of posts; letters of a title and a company (fixed values).
JOB_PLACES = [
    "linkedin.com/jobs", "indeed.", "glassdoor.", "naukri.com", "lever.co", "greenhouse.io", "ashbyhq.com", "myworkdayjobs.com", "workday", "wellfound.com",
    "angel.co", "remoteok", "weworkremotely.com", "remotive.com", "jobicy.com", "ziprecruiter.com", "dice.com", "monster.com", "instahyre.com", "cutshort.io",
    "hirist.", "ycombinator.com/jobs", "/careers", "careers.", "jobs.", "smartrecruiters.com", "workable.com", "recruitee.com", "jobvite.com", "bamboohr.com",
]
BOARDS = ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com"]
POSTS = ["linkedin.com/posts", "linkedin.com/feed", "linkedin.com/pulse"]
PARTS, HEADLINE, CAREERS = [" - ", " at ", " | ", " – "], [" | ", " on LinkedIn", " – ", " - "], [" - ", " | ", " – ", " at "]
BOARD_TERMS, POST_TERMS, CAREER_TITLE, POST_COMPANY = 3, 4, 120, 60
#: End of fixed values.


def results(payloads: DataFrame, *kept: str) -> DataFrame:
    """(ord, kept columns, url, title, content, published) of every result that has a url."""
    parsed = payloads.select("ord", *kept, F.try_variant_get(F.try_parse_json("payload"), "$.results", "array<variant>").alias("l"))
    rows = parsed.select("ord", *kept, F.posexplode("l").alias("n", "j")).where(F.schema_of_variant("j").startswith("OBJECT"))
    j = F.col("j")
    found = {"url": "url", "title": "title", "content": "content", "published": "published_date"}
    return computed_once(rows.select(item_ord(), *kept, *[first_filled(j, p).alias(c) for c, p in found.items()])).where("url <> ''")


def once(rows: DataFrame) -> DataFrame:
    """The first row of each url."""
    rest = [c for c in rows.columns if c not in ("ord", "url")]
    best = rows.groupBy("url").agg(F.min("ord").alias("ord"), F.min_by(F.struct(*rest), "ord").alias("r"))
    return best.select("ord", "url", *[f"r.{c}" for c in rest])


def parted(title: Column, parts: list[str]) -> Column:
    """(title, company): the first two pieces of a title at the first of the separators that it holds; else all of it and ""."""

    def cut(t: Column) -> Column:
        piece = lambda sep, i: F.trim(F.get(F.split(t, sep.replace("|", r"\|")), F.lit(i)))
        tries = [F.when(F.contains(t, F.lit(sep)), F.struct(piece(sep, 0).alias("title"), piece(sep, 1).alias("company"))) for sep in parts]
        return F.coalesce(*tries, F.struct(t.alias("title"), F.lit("").alias("company")))

    return named(title, cut)


def before_all(title: Column, parts: list[str]) -> Column:
    """What stands before each separator in turn."""
    return reduce(lambda c, sep: F.substring_index(c, sep, 1), parts, title)


def _remote(*texts: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit("remote"))


def _posting(rows: DataFrame, **c: Column) -> DataFrame:
    c = {"date_posted": F.lit(""), "is_remote": _remote("title", "content"), "job_url": F.col("url"), "description": F.col("content")} | c
    return rows.select("ord", *[c.get(k, F.col(k) if k in ("title", "company") else F.lit("")).alias(k) for k in POSTING[1:]])


def _split_results(rows: DataFrame) -> DataFrame:
    cut = computed_once(once(rows).withColumn("p", parted(F.col("title"), PARTS)))
    return cut.select("ord", "url", "p.title", "p.company", "content")


def web(payloads: DataFrame) -> DataFrame:
    """Results whose url is at a place of postings."""
    rows = results(payloads).where(contains_any(F.lower("url"), JOB_PLACES))
    return _posting(_split_results(rows), site=F.lit("tavily"))


def boards(payloads: DataFrame, location: str = "") -> DataFrame:
    """Results of the first terms whose url is at a known board."""
    rows = results(payloads.where(F.col("term_rank") < BOARD_TERMS)).where(contains_any(F.lower("url"), BOARDS))
    return _posting(_split_results(rows), site=F.lit("Career page (via Tavily)"), location=F.lit(location))


def hiring_posts(payloads: DataFrame, location: str = "") -> DataFrame:
    """Posts that results of the first terms lead to: the term is the title, the post's headline the company."""
    rows = once(results(payloads.where(F.col("term_rank") < POST_TERMS), "term").where(contains_any(F.lower("url"), POSTS)))
    role = F.array_join(F.transform(F.filter(F.split("term", r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    rows = computed_once(rows.withColumns({"headline": before_all(F.trim("title"), HEADLINE), "title": F.concat(role, F.lit(" — hiring post"))}))
    head = F.when(F.col("headline") != "", F.concat(F.lit(" — "), "headline")).otherwise("")
    return _posting(
        rows, company=F.coalesce(F.nullif(F.substring("headline", 1, POST_COMPANY), F.lit("")), F.lit("(LinkedIn post)")), location=F.lit(location or "India"), site=F.lit("LinkedIn post (via Tavily)"),
        date_posted=F.substring("published", 1, 10), description=F.substring(F.concat(F.lit("LinkedIn hiring post"), head, F.lit(". "), "content"), 1, DESCRIPTION),
    )


def careers(payloads: DataFrame, keywords: list[str], location: str = "") -> DataFrame:
    """Openings of companies (``company`` of a payload): the url is one opening's and title or content has a keyword."""
    rows = results(payloads, "company").where(is_posting_url(F.col("url")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat("company", F.lit(" role")))
    rows = computed_once(rows.withColumn("title", before_all(title, CAREERS)))
    rows = once(rows.where(keyword_match(F.concat_ws(" ", "title", "content"), F.array(*map(F.lit, keywords)).cast("array<string>"))))
    return _posting(rows, title=F.substring(F.trim("title"), 1, CAREER_TITLE), location=F.lit(location or NOWHERE), site=F.concat("company", F.lit(" careers (via Tavily)")))
