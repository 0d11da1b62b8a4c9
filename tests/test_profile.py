"""Profiles, scores of resumes, feed snapshots and runs, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from talus.operators import ats, feed, profile, rank
from talus.sources import snapshots

LEXICON = {"Go": ["go"], "SQL": ["sql"], "C++": ["c++"], "Node": ["node.js", "node"]}
DEFAULT = ["software engineer"]
INPUT = "id long, resume string, skills_text string, position string, years int, place string, remote boolean, wanted_companies string, least_pay int"


def of(spark, *rows):
    out = profile.from_resume(spark.createDataFrame(rows, INPUT), LEXICON, DEFAULT, "Home").orderBy("id").collect()
    return out[0] if len(out) == 1 else out


def test_profile_of_a_resume(spark):
    text = "Jane Roe\nBackend work with SQL and Go, node.js\nB.Sc. Physics\nAWS certified\nAt Acme Data Labs; later Orbit Systems\nacme data labs\nACME Data Labs again Labs\n5 years, 20 years\nCall +49 30 123-4567 or a.b@c.org. payments"
    p = of(spark, (1, text, "Kafka; go|Kafka ,  rust", "Lead Dev, Cook", 0, " Oslo ", True, "A;B,\n C", 5))
    assert (p.name, p.email, p.phone, p.education, p.certifications) == ("Jane Roe", "a.b@c.org", "+49 30 123-4567", "B.Sc. Physics", ["AWS certified"])
    assert p.companies_worked_at == ["At Acme Data Labs", "ACME Data Labs"]  # the first of each line
    assert (p.current_title, p.job_titles, p.target_titles) == ("Lead Dev", ["Backend Developer"], ["Backend Developer"])
    assert (p.primary_skills, p.secondary_skills, p.user_added_skills) == (["SQL", "Go", "Node"], [], ["Go", "Kafka", "rust"])
    assert p.all_searchable_skills == p.keywords == ["SQL", "Go", "Node", "Kafka", "rust"]
    assert (p.experience_years, p.experience_level, p.max_experience_to_search, p.location, p.remote_preference, p.min_salary) == (5, "MID", 6, "Oslo", "remote", 5)
    assert (p.domains, p.preferred_companies) == (["fintech"], ["A", "B", "C"])
    assert p.search_queries == ["Lead Dev SQL Go Node", "Backend Developer SQL Go", "SQL Go Node", "Lead Dev Go Kafka rust"]


def test_profile_of_nothing(spark):
    p = of(spark, (1, None, None, None, None, None, None, None, None))
    assert (p.name, p.email, p.phone, p.education, p.current_title, p.experience_years, p.experience_level, p.location, p.remote_preference, p.min_salary) == ("", "", "", "", "", 0, "JUNIOR", "Home", "any", 0)
    assert p.job_titles == p.primary_skills == p.user_added_skills == p.certifications == p.companies_worked_at == p.domains == p.preferred_companies == []
    assert p.search_queries == DEFAULT


@pytest.mark.parametrize("text,name", [("\n  Ada B. van Stone", ""), ("Ada B. Stone", "Ada B. Stone"), ("ada", ""), ("A B C D E", ""), ("Jane R0e", ""), ("x@y", ""), ("Éva Ünal", "Éva Ünal"), ("(Jane) Roe", "(Jane) Roe"), ("A" * 41, "")])
def test_names(spark, text, name):
    assert spark.range(1).select(profile.name_of(F.split(F.lit(text), "\n"))).first()[0] == name


def test_titles_without_roles_are_those_of_languages(spark):
    rows = spark.createDataFrame([("python and node",), ("backend, python, back-end",), (None,), ("iOS  app. QA x",)], "t string").select(profile.titles_in(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [["Node.js Developer", "Python Developer"], ["Backend Developer"], [], ["iOS Developer", "QA Engineer"]]


def test_edited_profiles(spark):
    rows = [(1, [" Go", "go", ""], None, ["x", "X", "y"], None, ["A", " a"], " 7 ", "x", "", "", None, None), (2, None, ["Go"], [], ["T"], None, "7.5", "-3", " ", None, "Rome", "remote")]
    names = "id long, primary_skills array<string>, secondary_skills array<string>, user_added_skills array<string>, target_titles array<string>, job_titles array<string>, experience_years string, min_salary string, current_title string, location string, location_preference string, remote_preference string"
    a, b = profile.after_edits(spark.createDataFrame(rows, names), DEFAULT, "Home").orderBy("id").collect()
    assert (a.primary_skills, a.secondary_skills, a.user_added_skills, a.all_searchable_skills, a.job_titles, a.current_title) == (["Go"], [], ["x", "y"], ["Go", "x", "y"], ["A"], "A")
    assert (a.experience_years, a.experience_level, a.min_salary, a.location, a.remote_preference, a.name, a.domains) == (7, "SENIOR", 0, "Home", "any", "", [])
    assert (b.primary_skills, b.job_titles, b.current_title, b.experience_years, b.min_salary, b.location, b.location_preference, b.remote_preference) == ([], ["T"], "T", 0, -3, "Rome", "Rome", "remote")
    assert a.search_queries == ["A Go", "Go", "A x y"]


def test_saved_profiles(spark):
    def years(summary, *dates):
        payload = json.dumps({"SUMMARY_TEMPLATE": summary, "DEFAULT_STACK": ["Go"], "SKILLS": {"a": ["SQL (x)", "sql", None], "b": None}, "EXPERIENCE": [{"title": "T", "dates": d} for d in dates]})
        return payload

    payloads = [years("9 years of {stack}", "Jan 2001"), years("x", "Jan 2020 - now", "March 2018"), years("x", "2018"), years("x", "Foo 2018", None), years("x", "Jan 2024"), None, "{"]
    rows = profile.from_saved(spark.createDataFrame(list(enumerate(payloads)), "id long, payload string"), LEXICON, F.lit("2024-01-30").cast("date"), DEFAULT).orderBy("id").collect()
    assert [r.experience_years for r in rows] == [9, 5, 2, 2, 1, 2, 2]
    assert rows[0].user_added_skills == ["SQL"] and rows[0].position == "T" and "9 years of Go" in rows[0].resume and rows[5].user_added_skills == []


def plain_score(text, made):
    low = text.lower()
    if len(text.strip()) < 100:
        return 0
    found = [k for k in ats.HARD_SKILLS if k in low]
    score = min(35, sum(min(low.count(k) * v, 2 * v) for k, v in ats.HARD_SKILLS.items())) + (min(10, len(found)) if made else 0)
    titles = sum(t in low for t in ats.TITLES)
    score += 15 if titles >= 2 else 8 if titles else 0
    sections = [v for k, v in ats.SECTIONS.items() if k in low]
    score += min(20, sum(sections) - (0 if len(sections) >= 3 else 5 if len(sections) == 2 else 10))
    score += 8 * (len(re.findall(r"20\d{2}", low)) >= 2) + 7 * (sum(low.count(v) for v in ats.VERBS) >= 5)
    section = len(low[low.find("skills") :]) if "skills" in low else 0
    score += min(20, (12 if section > 80 else 8 if section > 50 else 0) + (8 if "," in text or "•" in text else 5 if "-" in text else 0))
    score += 3 * bool(re.search(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", text)) + 2 * bool(re.search(r"(\+\d{1,3}|0)\d{6,}|\(\d{3}\)\s*\d{3}-\d{4}", text))
    score += 3 * any(w in low for w in ats.PLACES) + 2 * ("linkedin" in low or "github" in low)
    return min(100, max(score + 10, 85)) if made else min(100, score)


def test_scores_of_resumes(spark):
    rng = random.Random(3)
    pieces = ["python ", "go go ", "Senior Developer ", "Experience ", "EDUCATION ", "skills ", "projects, ", "2019 2021 ", "developed led ", "built created deployed ", "• ", "a-b ", "x@y.org ", "+4912345678 ", "located ", "GitHub ", "lorem ipsum dolor " * 5]
    rows = [("".join(rng.choices(pieces, k=rng.randrange(1, 25))), rng.random() < 0.3) for _ in range(200)] + [("", False), ("x" * 99, True), (" " * 200, True)]
    got = spark.createDataFrame(rows, "t string, made boolean").select("t", "made", ats.ats_score(F.col("t"), F.col("made")).alias("r")).collect()
    assert [(r.r.score, plain_score(r.t, r.made)) for r in got if r.r.score != plain_score(r.t, r.made)] == []
    assert all(len(x) <= 5 for r in got for x in (r.r.strengths, r.r.gaps, r.r.advice))
    none = spark.range(1).select(ats.ats_score(F.lit(None).cast("string")).alias("r")).first().r
    assert (none.score, none.gaps) == (0, ["too short"])


def test_snapshots_fall_back(spark, tmp_path):
    job = {"title": "t", "is_remote": True, "min_amount": 5, "company": None}
    whole = lambda x: json.dumps(x)
    rows = [
        ("live", 0, whole({"fetched_at": "now", "count": 9, "jobs": [job, 5, None]})), ("live", 1, whole([{"title": "old"}])), ("stale", 0, '{"jobs": ['), ("stale", 1, None), ("stale", 2, whole([{"title": "last good"}])),
        ("empty", 0, whole({"jobs": []})), ("empty", 1, whole([job])), ("odd", 0, "7"), ("odd", 1, whole([job])), ("none", 0, "{"), ("bare", 0, whole({"count": 1})), ("text", 0, ""),
    ]
    got = sorted((r.feed, r["rank"], r.fetched_at, r.n, r.title, r.is_remote, r.min_amount, r.company) for r in snapshots.feeds(spark.createDataFrame(rows, "feed string, rank int, payload string")).collect())
    assert got == [("live", 0, "now", 0, "t", "true", "5", ""), ("stale", 2, None, 0, "last good", "", "", "")]
    for name, text in (("broken", "{"), ("good", whole([job, job]))):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("nothing", "broken", "good")]
    assert [(r["rank"], r.n) for r in snapshots.feeds(snapshots.snapshot_files(spark, paths)).orderBy("n").collect()] == [(2, 0), (2, 1)]
    assert snapshots.feeds(snapshots.snapshot_files(spark, paths[:2])).collect() == snapshots.feeds(snapshots.snapshot_files(spark, paths[:1])).collect() == []


def test_written_feeds_and_lines(spark, tmp_path):
    df = feed.project(spark.createDataFrame([(i, f"t{i}", i % 2 == 0, 'a "b", c\nd') for i in range(5)], "ord long, title string, is_remote boolean, company string"), "now")
    feed.write_feed(df, str(tmp_path / "f"), "now", [F.desc("title")], 3)
    (part,) = (tmp_path / "f").glob("part-*")
    read = json.loads(part.read_text())
    assert (read["fetched_at"], read["count"], [j["title"] for j in read["jobs"]], list(read["jobs"][0])) == ("now", 5, ["t4", "t3", "t2"], feed.COLUMNS)
    lines = feed.csv_lines(spark.createDataFrame([(1, None, 'x "y"', ["a", "b,c"], 2.5)], "ord long, a string, b string, c array<string>, d double"), ["a", "b", "c", "d"], ["ord"])
    assert lines.first().line == ',"x ""y""","a; b,c",2.5'


def test_cards(spark):
    html = '<ul><li class="x"><h3 class="a base-search-card__title b"> Dev &amp; <b>Ops </b></h3><a href="/firm"></a><a data-x="1" class="y base-card__full-link" href="https://j.org/1?x=2">z</a><h4 class=\'base-search-card__subtitle\'>Acme</h4></li>'
    html += '<li><h3 class="not-base-search-card__title">x</h3><a href="u">y</a></li><li><h3 class="base-search-card__title">T</h3></li><LI><p class="base-search-card__title">Remote</p><a href="only?q">y</a></LI></ul>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "no list")], "ord long, payload string")
    rows = snapshots.cards(df, "India").orderBy("ord").collect()
    assert [(r.title, r.company, r.location, r.job_url, r.is_remote) for r in rows] == [("Dev &Ops", "Acme", "India", "https://j.org/1", False), ("Remote", "", "India", "only", True)]
    assert snapshots.cards(df, most=1).count() == 1 and snapshots.cards(df.limit(0)).collect() == []


def test_runs_report_what_they_turn_down(spark):
    shape = "ord long, title string, company string, site string, job_url string, score int, days int, skill_ratio double, reason string"
    rows = [(1, "a", "c", "s", "u1", 90, 1, 0.7, None), (2, "b", "c", "s", "u1", 95, 1, 0.9, None), (3, "c", "c", "s", "u2", 80, 1, 0.55, None), (4, "d", "c", "s", "u3", 49, 1, None, None), (5, "e", "c", "s", "", 90, 1, 0.1, None), (6, "f", "c", "s", "u4", 90, 1, 0.4, "senior title"), (7, "g", "c", "s", "u5", 90, 1, 0.9, "senior title")]
    df = spark.createDataFrame(rows, shape)

    def both(k, n):
        jobs, rejected, summary = rank.run(df, k, at_least=n)
        s = summary.first()
        return [r.ord for r in jobs.orderBy("place").collect()], [(r.ord, r.reason) for r in rejected.orderBy("ord").collect()], (s.fetched, s.kept, s.rejected_count, s.relaxed, s.min_ratio)

    assert both(5, 1) == ([1], [(3, "skills 55% of 60%"), (4, "score 49 of 50"), (6, "skills 40% of 60%"), (7, "senior title")], (7, 1, 4, False, 0.6))
    assert both(5, 2) == ([1, 3, 4], [(6, "skills 40% of 50%"), (7, "senior title")], (7, 3, 2, True, 0.5))
    assert both(1, 2)[2] == (7, 1, 4, False, 0.6)
    empty = [x.collect() for x in rank.run(df.limit(0), 5)]
    assert empty[:2] == [[], []] and (empty[2][0].fetched, empty[2][0].kept, empty[2][0].relaxed) == (0, 0, False)
