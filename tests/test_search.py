"""Results of searches as postings; views, choices and tenants of companies."""

import json

from pyspark.sql import functions as F

from talus.operators import companies as C
from talus.sources import search_results as S


def landed(spark, *lists):
    rows = [(i, i, f"node.js bACKEND t{i}", "Acme", json.dumps({"results": x}) if isinstance(x, list) else x) for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "ord long, term_rank int, term string, company string, payload string")


def hit(url, title="", content="", **more):
    return {"url": url, "title": title, "content": content} | more


def test_web_and_board_results(spark):
    df = landed(spark, [hit("https://x.org/careers/1", "Dev at Acme - Remote | y", "c"), hit("https://x.org/blog"), hit("", "t"), 5, None], [hit("https://x.org/careers/1", "later"), hit("https://jobs.lever.co/a", "Dev | ", None)], "{", None, [hit("https://boards.greenhouse.io/late", "T")])
    got = sorted((r.job_url, r.title, r.company, r.is_remote) for r in S.web(df).collect())
    assert got == [("https://boards.greenhouse.io/late", "T", "", False), ("https://jobs.lever.co/a", "Dev", "", False), ("https://x.org/careers/1", "Dev at Acme", "Remote | y", False)]
    assert sorted(r.job_url for r in S.boards(df).collect()) == ["https://jobs.lever.co/a"]  # of the first three terms


def test_posts_and_careers(spark):
    long = "x" * 2000
    df = landed(spark, [hit("https://LinkedIn.com/posts/1", " Jane on LinkedIn: hi - x", long, published_date="2024-01-02T1"), hit("https://linkedin.com/in/1", "no")], [hit("https://linkedin.com/feed/2", "", "Remote")], [], [], [hit("https://linkedin.com/posts/late")])
    a, b = S.hiring_posts(df).orderBy("job_url").collect()
    assert (a.title, a.company, a.date_posted, len(a.description), a.location) == ("Node.js Backend T0 — hiring post", "Jane", "2024-01-02", 1500, "India")
    assert (b.company, b.description, b.is_remote) == ("(LinkedIn post)", "LinkedIn hiring post. Remote", True)
    df = landed(spark, [hit("https://x.org/careers", "Backend"), hit("https://x.org/careers/1", "Cook"), hit("https://x.org/jobs/2", "", "backend"), hit("https://x.org/jobs/3", "Backend Dev | Acme - x")], [hit("https://x.org/careers/1", "Backend")])
    assert sorted((r.job_url, r.title, r.site) for r in S.careers(df, ["Backend"]).collect()) == [("https://x.org/careers/1", "Backend", "Acme careers (via Tavily)"), ("https://x.org/jobs/2", "Acme role", "Acme careers (via Tavily)"), ("https://x.org/jobs/3", "Backend Dev", "Acme careers (via Tavily)")]
    assert S.web(df.limit(0)).collect() == S.hiring_posts(df.limit(0)).collect() == []


def test_views_choices_and_records(spark):
    rows = [(1, "Neural Labs", "AI / ML", "Coworking", "http://a", "Main"), (2, "Bakers", "Food", "Retail", None, None), (3, None, None, None, "", "Main")]
    df = spark.createDataFrame(rows, "ord long, company_name string, industry string, business_type string, website string, address string")
    view = lambda **how: sorted(r.ord for r in C.viewed(df, **how).collect())
    assert view() == [1] and view(firms_only=False) == [1, 2, 3] and view(firms_only=False, text="MAIN") == [1, 3] and view(firms_only=False, with_site=True) == [1]
    assert view(firms_only=False, kind="Retail") == [2] and view(firms_only=False, industry="Food", text="bake") == [2] and view(firms_only=False, shared=True) == [1]
    assert sorted(tuple(r) for r in C.choices(df).collect()) == [("business_type", "Coworking", 1), ("business_type", "Retail", 1), ("industry", "AI / ML", 1), ("industry", "Food", 1)]
    record = C.web_record(df, F.lit(True), "Web").where("ord = 3").first()
    assert (record.website, record.latitude, record.hiring, record.emails, record.social_links, record.source, record.non_technical_work) == ("", None, None, [], {}, ["Web"], False)


def test_techniques_and_tenants(spark):
    rows = spark.createDataFrame([("<i NG-VERSION>", None), (None, "X-Powered-By: Express"), (None, None)], "p string, h string").select(C.techniques(F.col("p"), F.col("h")).alias("t")).collect()
    assert [r.t for r in rows] == [["Angular"], ["Express", "Node.js"], []]
    features = spark.createDataFrame([(1, {"name": "Tech Park"}), (2, {"name": "ab", "office": "coworking"}), (3, {"office": "coworking"}), (4, {"name": "Desk", "office": "shared_x"}), (5, {"name": "x", "office": "it"}), (6, None)], "ord long, tags map<string,string>")
    assert [r.space for r in C.shared_spaces(features).orderBy("ord").collect()] == ["Tech Park", "Desk"]
    titles = spark.createDataFrame([(1, "Acme Data Systems, acme data systems and Orbit Tech"), (2, "ACME DATA Systems"), (3, None)], "ord long, title string")
    assert sorted(r.company_name for r in C.tenants(titles).collect()) == ["Acme Data Systems", "Orbit Tech"]


def test_scans_edits_and_aliases(spark):
    from talus.operators.lexicon import alias_map
    from talus.operators.profile import after_edits, with_edits
    from talus.sources.payloads import scanned

    a = spark.createDataFrame([(1, "u", "x", None), (2, None, "y", "c")], "ord long, job_url string, title string, company string")
    b = spark.createDataFrame([(1, "", "late"), (2, "u", "late"), (3, "v", None)], "ord long, job_url string, title string")
    for n in (1, 4):
        rows = scanned([("t", a.repartition(n)), ("s", b.repartition(n))]).collect()
        assert sorted((r.job_url, r["rank"], r.search_term, r.ord, r.title, r.company) for r in rows) == [("", 0, "t", 2, "y", "c"), ("u", 0, "t", 1, "x", ""), ("v", 1, "s", 3, "", "")]
    p = spark.createDataFrame([(i, ["Go"], ["x"], ["Dev"], ["Dev"], 4, "any") for i in range(3)], "id long, primary_skills array<string>, user_added_skills array<string>, target_titles array<string>, job_titles array<string>, experience_years int, remote_preference string")
    e = spark.createDataFrame([(0, " A,, b ", "", None, "7 or 8", "remote"), (1, None, None, " ", "x", None)], "id long, titles string, skills string, added string, years string, remote string")
    rows = after_edits(with_edits(p, e, "id"), ["any job"], "Home").orderBy("id").collect()
    assert [(r.job_titles, r.primary_skills, r.user_added_skills, r.experience_years, r.remote_preference) for r in rows] == [(["A", "b"], [], ["x"], 7, "remote"), (["Dev"], ["Go"], [], 0, "any"), (["Dev"], ["Go"], ["x"], 4, "any")]
    m = spark.createDataFrame([(2, "Go (Golang)", "golang"), (1, " Go", "go"), (3, None, "z"), (4, "Go", None)], "ord long, label string, alias string")
    assert sorted((r.label, r.aliases) for r in alias_map(m).collect()) == [("", ["z"]), ("Go", ["go", "golang"])]
