"""Companies from maps, search results and pages, on hand-made rows."""

from pyspark.sql import functions as F

from talus.operators import discovery as D
from talus.operators import filters
from talus.operators import resume as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def tags(**values):
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k.replace("__", ":"), v)])


def test_feature_classes_come_in_order(spark):
    def kind(**t):
        return tuple(one(spark, D.feature_class(tags(**t))))

    assert kind(name="X", office="coworking") == ("Coworking Space", "Coworking", False, True)
    assert kind(name="Neural NLP", office="lawyer") == ("Legal", "Company / Office", False, True)
    assert kind(name="Neural NLP", office="company") == ("AI / ML", "Company / Office", True, False)
    assert kind(name="Neural NLP", shop="bakery") == ("Retail (bakery)", "Local Business / Retail", False, True)
    assert kind(name="X", healthcare="yes", amenity="bank") == ("Healthcare", "Healthcare", False, True)
    assert kind(name="X", amenity="drive-in_cinema") == ("Drive-In Cinema", "Local Business", False, True)
    assert kind(name="X") == ("Business", "Business", False, True)


def test_noise_needs_a_business_tag(spark):
    assert not one(spark, D.is_company(tags(name="P", amenity="parking")))
    assert one(spark, D.is_company(tags(name="P", amenity="parking", shop="kiosk")))
    assert not one(spark, D.is_company(tags(amenity="cafe")))


def test_names_in_text(spark):
    text = "Nova Labs, then NOVA Labs and Nova Labs. Backend Software. The Big Solutions; Orbit  Group Pvt Ltd"
    assert one(spark, D.names_in(F.lit(text))) == ["Nova Labs", "Nova Labs. Backend Software", "Group Pvt Ltd"]
    assert one(spark, D.names_in(F.lit(None).cast("string"))) == []
    assert one(spark, D.names_in(F.lit("Orbit Group Pvt Ltd, A1 Networks"))) == ["Orbit Group Pvt Ltd", "A1 Networks"]


def test_titles(spark):
    assert one(spark, D.title_name(F.lit("Top 10 firms | Nova Labs | home"))) == "Nova Labs"
    assert one(spark, D.title_name(F.lit("Best of town"))) is None


def test_site_facts(spark):
    html = "<a href='jobs.html'>j</a> b@x.org hr@x.org b@x.org https://github.com/abc?a=1&amp;b=2."
    x = D.site_facts(F.lit(html), F.lit("https://x.org/"))
    row = spark.range(1).select(*[v.alias(k) for k, v in x.items()]).first()
    assert row.emails == ["b@x.org", "hr@x.org"] and row.hr_emails == ["hr@x.org"]
    assert row.social_links == {"github": "https://github.com/abc?a=1&b=2"}
    assert row.careers == "https://x.org/jobs.html" and row.hiring
    empty = spark.range(1).select(*[v.alias(k) for k, v in D.site_facts(F.lit(None).cast("string"), F.lit(None).cast("string")).items()]).first()
    assert (empty.emails, empty.careers, empty.hiring) == ([], "", False)


def test_parent_area(spark):
    assert one(spark, D.parent_area(F.lit("Sector 1, Old Town, Utopia"), "utopia")) == "Old Town"
    assert one(spark, D.parent_area(F.lit("Alone"), "utopia")) is None


def test_required_skills_come_from_their_sections(spark):
    lexicon = {"Java": ["java"], "Go": ["go"]}
    text = "We like Go.\nMust have: java\n\nNice to have: go"
    assert one(spark, filters.required_skills(F.lit(text), lexicon)) == ["Java"]
    assert one(spark, filters.required_skills(F.lit("We like go."), lexicon)) == ["Go"]
    assert one(spark, filters.required_skills(F.lit("Required: Node.js, react"), lexicon)) == ["Node.js", "React"]
    assert one(spark, filters.required_skills(F.lit(None).cast("string"), lexicon)) == []


def test_feed_is_ranked_analysed_and_filled(spark):
    from talus.operators import feed

    rows = [
        (1, "a", "python", 90, "2024-01-10", True), (2, "b", "java", 80, "2024-01-20", True), (3, "c", "python", 70, "2024-01-29", False), (4, "a", "late a", 10, "2024-01-02", True),
        (5, "d", "python", 60, "2024-01-28", True), (6, "", "python", 99, "2024-01-28", True), (7, "e", "python", 50, "2024-01-28", None), (8, "e", "python", 50, "2024-01-28", None), (9, "f", "ruby", 50, None, None),
    ]
    df = spark.createDataFrame(rows, "ord long, job_url string, description string, score int, date_posted string, ok boolean").withColumn("days", F.lit(3))
    as_of, delta = F.lit("2024-01-30").cast("date"), F.length("description")
    fits = F.col("description") == "python"

    def of(**how):
        got = feed.ranked(df, df, F.coalesce("ok", F.lit(False)), F.col("ok").isNotNull(), delta, fits, as_of, **how).orderBy("place").collect()
        return [(r.ord, r.place, r.delta, r.filled) for r in got]

    assert of(at_least=3, floor=0) == [(5, 1, 6, False), (4, 2, 6, False), (2, 3, 4, False)]  # the last row of a, with its text and age
    assert of(at_least=4, floor=0) == [(3, 1, 6, False), (5, 2, 6, False), (4, 3, 6, False), (2, 4, 4, False)]  # relaxed
    assert of(at_least=3, floor=0, analysed=1) == [(4, 1, 6, False), (5, 2, 0, False), (2, 3, 0, False)]
    assert of(at_least=3, floor=0, most=1) == [(4, 1, 6, False)]
    assert of(at_least=3, floor=4) == [(5, 1, 6, False), (4, 2, 6, False), (2, 3, 4, False), (3, 4, 0, True)]
    assert of(at_least=3, floor=9)[3:] == [(3, 4, 0, True), (7, 5, 0, True)]


def test_borders_of_patterns_are_ascii(spark):
    from talus.operators import scoring

    cases = {r"\bbe\b": ["be", "x be.", "ébe", "be1", "abe", "be_"], r"\b2\s*-\s*3\s*years?\b": ["2-3 years", "2 - 3 year", "12-3 years", "2-3 yearsx", "2-3 yearé"], r"\bwe\s+(?:mentor|coach)\b": ["we mentor", "we  coaches", "owe mentor"], r"c\+\+\b": ["c++a", "c++ "], r"\b\+1": ["a+1", " +1"]}
    import re

    for pattern, texts in cases.items():
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.signal_count(F.col("t"), [pattern]).alias("n")).collect()
        assert {r.t: r.n for r in rows} == {t: int(re.search(pattern, t, re.ASCII) is not None) for t in texts}


def test_lines_and_terms(spark):
    parts = {"present": F.array(F.lit("A"), F.lit("B")), "typed": F.array(F.lit("B"), F.lit("C")), "suggestions": F.array(F.lit("D"))}
    assert one(spark, R.skills_line(parts)) == "A, B, C" and one(spark, R.skills_line(parts, True)) == "A, B, C, D"
    assert one(spark, R.longest_first(F.array(F.lit("a"), F.lit("ccc"), F.lit("b"), F.lit("ddd")))) == ["ccc", "ddd", "a", "b"]
    assert one(spark, R.search_terms(F.lit(" x, y;X"), F.array(F.lit("t")), F.array(F.lit("y"), F.lit("z")))) == ["x", "y", "t", "z"]
