"""Expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from talus.functions import text as T
from talus.operators import companies, rank, resume, scoring
from talus.operators.lexicon import ordered_tags, tags
from talus.sources import payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_years(spark):
    assert one(spark, T.most_years(F.lit("3+ years"))) == 3
    assert one(spark, T.most_years(F.lit("2-4 years, 1 yr, 99 years"))) == 4
    assert one(spark, T.least_years(F.lit("2-4 years, 1 yr"))) == 1
    assert one(spark, T.most_years(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize(("raw", "n"), [("201-500", 201), ("5,001-10,000", 5001), ("10000+", 10000), ("", 0), (None, 0)])
def test_headcount(spark, raw, n):
    assert one(spark, scoring.headcount(F.lit(raw).cast("string"))) == n


def test_words_stand_alone(spark):
    assert not one(spark, T.has_word(F.lit("google restaurants"), "go"))
    assert one(spark, T.has_word(F.lit("Go, c++"), "go")) and one(spark, T.has_word(F.lit("Go, C++."), "c++"))


def test_tags(spark):
    lexicon = {"C++": ["c++"], "Go": ["go", "golang"], "SQL": ["sql"]}
    assert one(spark, tags(F.lit("SQL then Go"), lexicon)) == ["Go", "SQL"]
    assert one(spark, ordered_tags(F.lit("SQL then golang"), lexicon)) == ["SQL", "Go"]
    assert one(spark, tags(F.lit(None).cast("string"), lexicon)) == []


def test_title_relevance(spark):
    rate = lambda t: one(spark, scoring.title_relevance(F.lit(t), ["Backend Developer"]))
    assert (rate("Backend Engineer"), rate("Data Engineer"), rate("Sales Manager")) == (1.0, 0.3, 0.0)
    assert one(spark, scoring.title_relevance(F.lit("x"), [])) == 0.5


def test_pay_rounds_half_to_even(spark):
    assert one(spark, scoring.pay_boost(F.lit(8.25), 7.0)) == 2 and one(spark, scoring.pay_boost(F.lit(7.75), 7.0)) == 2


def test_days(spark):
    old = lambda s: one(spark, scoring.days_old(F.lit(s).cast("string"), F.lit("2024-01-30").cast("date")))
    assert (old("2024-01-28T10:00"), old("2024-02-05"), old(""), old("soon"), old(None)) == (2, 0, 9999, 9999, 9999)


def test_strip_html(spark):
    assert one(spark, T.strip_html(F.lit("<script>x</script><p>a &amp;  b</p><b>c</b>"))) == "a & b\n c"


def test_distinct_ignoring_case(spark):
    assert one(spark, T.distinct_ignoring_case(F.array(*map(F.lit, ["Go", " go", "", "SQL"])))) == ["Go", "SQL"]


def test_company_key(spark):
    assert one(spark, T.company_key(F.lit("The Acme Pvt. Ltd"))) == "acme"


def test_search_queries(spark):
    q = one(spark, resume.search_queries(F.lit("Engineer"), F.lit("MID"), F.array(F.lit("Go"), F.lit("SQL")), F.lit("Bern")))
    assert q == ["Engineer Bern", "mid Engineer", "Go SQL developer", "Engineer Go"]


def test_first_wins_takes_the_earliest_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "", "z"), (4, None, "w")], "ord long, job_url string, t string")
    once = rank.first_wins(df, "job_url")
    assert sorted(r.ord for r in once.collect()) == [1, 2]
    assert sorted(map(tuple, rank.first_wins(once, "job_url").collect())) == sorted(map(tuple, once.collect()))
    assert [r.ord for r in rank.first_wins(df, "job_url", drop_blank=True).collect()] == [1]


def test_diversify_takes_turns_within_a_tier(spark):
    rows = [(i, 90 if i < 5 else 80, s, 1) for i, s in enumerate("aaabbab")]
    df = spark.createDataFrame(rows, "ord long, score int, site string, days int")
    assert [r.ord for r in rank.diversify(df, 7).orderBy("place").collect()] == [0, 3, 1, 4, 2, 5, 6]


def test_relax_at_the_threshold(spark):
    df = spark.range(10)
    strict, loose = F.col("id") < 5, F.col("id") < 8
    assert rank.relax(df, strict, loose, 5).count() == 5 and rank.relax(df, strict, loose, 6).count() == 8


def test_company_merge(spark):
    rows = [
        (1, "A", "http://www.x.org/", 1.0, 2.0, ["map"]), (2, "B", "https://x.org", None, None, ["web"]),
        (3, "a ", "", 1.00001, 2.0, ["dir"]), (4, "C", None, None, None, ["map"]),
    ]
    df = spark.createDataFrame(rows, "ord long, company_name string, website string, latitude double, longitude double, source array<string>")
    assert sorted((r.ord, r.source) for r in companies.merge(df).collect()) == [(1, ["dir", "map", "web"]), (4, ["map"])]


def test_sources_are_tolerant(spark):
    good = '{"jobs": [{"title": "Backend Engineer", "company_name": "A", "url": "u", "description": "<p>x</p>"}]}'
    df = spark.createDataFrame([(1, good), (2, "not json"), (3, None)], "ord long, payload string")
    rows = payloads.remotive(df).collect()
    assert [(r.title, r.location, r.description) for r in rows] == [("Backend Engineer", "Remote", "x")]
    rss = "<rss><channel><item><title>Acme: Engineer</title><link>u</link><pubDate>d</pubDate></item></channel></rss>"
    rows = payloads.weworkremotely(spark.createDataFrame([(1, rss)], "ord long, payload string")).collect()
    assert [(r.company, r.title, r.job_url) for r in rows] == [("Acme", "Engineer", "u")]


def test_items_of_long_payloads_keep_their_own_ordinals(spark):
    import json

    long = json.dumps({"jobs": [{"title": "t", "url": str(i)} for i in range(100_001)]})
    df = spark.createDataFrame([(1, long), (2, '{"jobs": [{"title": "t", "url": "last"}]}')], "ord long, payload string")
    rows = payloads.remotive(df)
    assert rows.select("ord").distinct().count() == 100_002 and rows.orderBy(F.desc("ord")).first().job_url == "last"


def test_computed_once_keeps_rows_and_filters_above(spark):
    from talus.functions.plan import computed_once

    df = computed_once(spark.range(5).withColumn("x", F.col("id") * 2)).where("x > 4")
    assert [tuple(r) for r in df.collect()] == [(3, 6), (4, 8)]


def test_aliases_of_runs_and_of_several_words(spark):
    lexicon = {"Net": [".net"], "Node": ["node", "node.js"], "Spring": ["spring"], "Boot": ["spring boot"], "C#": ["c#"]}
    assert one(spark, tags(F.lit("Spring Boot, node.js x.spring c# .NET"), lexicon)) == ["Boot", "C#", "Net", "Node", "Spring"]
    assert one(spark, tags(F.lit("x.spring c#x nodes"), lexicon)) == []


def test_industry_colour_and_openings(spark):
    kinds = [one(spark, companies.industry_for(F.lit(n), F.lit("Other"))) for n in ("Neural Works", "Email Systems", "Dubai Bakers", None)]
    assert kinds == ["AI / ML", "IT / Software", "Other", "Other"]
    colours = [one(spark, companies.map_colour(F.lit(i), F.lit(b), F.lit(t))) for i, b, t in (("x", "Coworking", True), ("x", "y", True), ("Finance", None, None), ("z", "", False))]
    assert colours == ["#a78bfa", "#3b82f6", "#22c55e", "#94a3b8"]
    urls = [one(spark, companies.openings_url(F.lit(c), F.lit(n), "s?q=")) for c, n in (("own", "n"), ("", "a b&(c)"), (None, None))]
    assert urls == ["own", "s?q=a%20b%26(c)", "s?q="]


def test_stated_years(spark):
    text = "1 to 3 years\n2 people, no year\n40 years, 5 - or so years"
    assert one(spark, T.stated_years(F.lit(text))) == 1 and one(spark, T.stated_years(F.lit("30 years"))) == 0 and one(spark, T.stated_years(F.lit(None).cast("string"))) == 0


def test_generic_top_relaxes(spark):
    rows = [(i, "u" if i < 2 else f"u{i}", ["a"], 10, i, 0) for i in range(6)] + [(9, "", ["a", "b"], 99, 99, 0)]
    df = spark.createDataFrame(rows, "ord long, job_url string, matched array<string>, base int, score int, days int")
    assert [r.ord for r in rank.generic_top(df, True, 3).collect()] == [5, 4, 3]
    assert rank.generic_top(df, False, 9).collect() == []


def test_references_decode_as_an_independent_decoder_says(spark):
    import html
    from html.entities import html5

    from talus.functions.references import unescaped

    texts = [f"{a}&{k}{b}" for k in html5 for a, b in (("", ""), ("x", "y&amp;"))]
    texts += [f"&#{n};" for n in [*range(300), 55296, 57343, 65534, 64976, 131070, 1114111, 1114112, 10**14]] + [f"x&#x{n:X}z" for n in [*range(200), 0x1F600, 0x10FFFF, 0x110000]]
    texts += ["", "&", "&&&", "& b", "&;", "&#;", "&#x;", "&nosuch;", "&notit;", "&copyreing more;", "&" + "a" * 40 + ";", "&#xZ;", "é&eacute&eacute;日本&#26085;", "&amp;lt;", "&#65&#66;", "a&\tb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in rows if r.u != html.unescape(r.t)] == []
    assert one(spark, unescaped(F.lit(None).cast("string"))) is None


def _young(rows):
    return sorted(r.job_url for r in rows.collect())


def test_fields_of_many_kinds(spark):
    import json

    jobs = [
        {"title": "Backend &amp; API", "seniority": ["Senior", "Mid-level"], "pubDate": 1706140800, "guid": "u1", "locationRestrictions": ["A", None, 3], "description": "<p>x &eacute;</p>"},
        {"title": "Backend", "seniority": "Senior", "url": "u2"},
        {"title": "java", "seniority": None, "pubDate": "2024-01-20T23:30:00-05:00", "url": "u3", "locationRestrictions": "no"},
        {"title": "java", "pubDate": 0, "date": "2024-01-01", "url": "old"},
        {"title": "java", "pubDate": {"x": 1}, "url": "u4", "company_name": "C"},
        {"title": "java", "pubDate": "99999999999999", "applicationLink": "", "guid": None, "url": "u5"},
        {"title": "Gardener", "url": "u6"}, {"title": None, "url": "u7"}, {"title": "java"}, 5, None, "x", [],
    ]
    rows = [(1, json.dumps({"jobs": jobs, "data": "x"})), (2, '{"jobs": [{"title": "java", "ur'), (3, None), (4, ""), (5, "[]"), (6, json.dumps({"jobs": [], "data": [{"title": "api", "url": "u8", "pubDate": "1706140800"}]}))]
    as_of = F.lit("2024-01-30T00:00:00Z").cast("timestamp")
    df = payloads.himalayas(spark.createDataFrame(rows, "ord long, payload string"), 240, as_of)
    got = {r.job_url: (r.title, r.company, r.location, r.date_posted, r.description) for r in df.collect()}
    assert got == {
        "u1": ("Backend &amp; API", "", "A, None, 3", "2024-01-25", "x é"), "u3": ("java", "", "Remote", "2024-01-20", ""), "u4": ("java", "C", "Remote", '{"x":1}', ""),
        "u5": ("java", "", "Remote", "9999999999", ""), "u8": ("api", "", "Remote", "2024-01-25", ""),
    }
    assert payloads.himalayas(spark.createDataFrame([], "ord long, payload string")).collect() == []


def test_times_are_utc_whatever_the_session_says(spark):
    from talus.operators.filters import age_within

    cases = {"2024-01-29": True, "2024-01-28T23:59:59": False, "2024-01-29T00:30:00+02:00": False, "2024-01-29T02:30:00+02:00": True, "2024-01-29T00:00:00Z": True, "soon": True, "": True, "2024-01-28 23:59:59.999": False, "2024-01-28T23:59:59 and more": False, "2024-01-28x": False}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            as_of = F.lit("2024-01-30T00:00:00Z").cast("timestamp")
            rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", age_within(F.col("d"), as_of, 24).alias("ok")).collect()
            assert {r.d: r.ok for r in rows} == cases
            assert one(spark, payloads.iso(F.lit(-1).cast("long"))) == "1969-12-31T23:59:59"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_urls_dates_and_comments_of_boards(spark):
    import json

    def of(x):
        return spark.createDataFrame([(1, json.dumps(x))], "ord long, payload string")

    as_of = F.lit("2024-01-30T00:00:00Z").cast("timestamp")
    ashby = [{"title": "Backend", "jobUrl": "a"}, {"title": "Backend", "applyUrl": "b"}, {"title": "Backend", "id": 7}, {"title": "Backend"}, {"title": "Cook", "jobUrl": "c"}]
    assert _young(payloads.ashby(of({"jobs": ashby}), "Acme", "acme", ["Backend Engineer"])) == ["a", "b", "https://jobs.ashbyhq.com/acme/7"]
    lever = [{"text": "Backend", "hostedUrl": "old", "createdAt": 1704067200000}, {"text": "Backend", "hostedUrl": "new", "createdAt": 1706486400999}, {"text": "x", "hostedUrl": "late", "descriptionPlain": "y" * 1500 + "backend"}]
    rows = payloads.lever(of(lever), "Acme", ["backend"], 240, as_of)
    assert [(r.job_url, r.date_posted, r.description, r.location) for r in rows.collect()] == [("new", "2024-01-29", "Backend at Acme", "—")]
    comments = [{"id": i, "text": f"Backend {i}<p>more"} for i in range(100)]
    assert payloads.hackernews(of({"children": comments}), ["backend"]).count() == 80
    jobicy = [{"jobTitle": "a", "url": "u", "pubDate": "2023-01-01"}, {"jobTitle": "b", "url": "u", "date": "2024-01-29"}, {"jobTitle": "c", "url": "u"}]
    assert [r.title for r in payloads.jobicy(of({"jobs": jobicy}), 240, as_of).collect()] == ["b"]
    rok = [{"legal": 1}, {"position": "Cook", "tags": ["golang"], "apply_url": "t"}, {"position": "Cook", "tags": None}, {"position": "SDE", "tags": "x", "url": "s"}]
    assert _young(payloads.remoteok(of(rok))) == ["s", "t"]


def test_fan_in_does_not_depend_on_partitions(spark):
    a = spark.createDataFrame([(1, "Lead", "u"), (2, "Dev", "v"), (3, "Dev", None), (4, "Dev", "w")], "ord long, title string, job_url string")
    b = spark.createDataFrame([(1, "Dev", "u", "x"), (2, "Other", "v", "x"), (3, "Dev", "", "x")], "ord long, title string, job_url string, extra string")
    wanted = [("u", 1, 1), ("v", 0, 2), ("w", 0, 4)]
    for n in (1, 5):
        rows = payloads.fan_in([a.repartition(n), b.repartition(n)], "JUNIOR").collect()
        assert sorted((r.job_url, r["rank"], r.ord) for r in rows) == wanted
    assert payloads.fan_in([a, b], first_only=False).count() == 5
