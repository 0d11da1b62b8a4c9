"""Resume blocks, bold runs, summaries, areas and the table of analyses, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talus.operators import areas, feed, resume


def heading(line):
    s = line.strip().rstrip(":").strip()
    letters = [c for c in s if c.isalpha()]
    return bool(s) and len(s) <= 40 and (s.lower() in resume.SECTIONS or bool(letters) and len(s.split()) <= 5 and sum(c.isupper() for c in letters) / len(letters) >= 0.8)


def contact(line):
    return any(x in line.lower() for x in ("@", "http", "linkedin", "github", "|")) or re.search(r"\+?[0-9][0-9\s()\-]{7,}", line) is not None


def brute(text, skills):
    lines = [x for x in (text or "").splitlines() if x.strip()]
    out, at = [], 1
    if lines:
        out.append(("name", lines[0].strip()))
        while at < len(lines) and at < 3 and contact(lines[at]) and not heading(lines[at]):
            out.append(("contact", lines[at].strip()))
            at += 1
    if skills:
        out += [("skillhead", "KEY SKILLS FOR THIS ROLE"), ("skills", skills)]
    for x in lines[at:]:
        s = x.lstrip()
        if heading(x):
            out.append(("heading", x.strip().rstrip(":").upper()))
        elif s[0] in resume.BULLETS and s[:2] != "--":
            out.append(("bullet", s[1:].strip()))
        else:
            out.append(("body", x.strip()))
    return out


def test_blocks(spark):
    rng = random.Random(6)
    pieces = ["Jane Roe", "x@y.org", "GitHub.com/x", "+1 (555) 123-4567", "a | b", "SKILLS:", "Work Experience", "MAIL: A@B.ORG", "plain text", "• did", "- did", "-- no", "", " \t", "ÜBER UNS", "ONE TWO THREE FOUR FIVE SIX", " glyph", "日本", "AB cd"]
    texts = [rng.choice(["\n", "\r\n", "\x0b", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, "", "one"]
    rows = [(i, t, rng.choice(["", "Go"])) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i long, t string, s string").select("i", resume.blocks(F.col("t"), F.col("s")).alias("b")).collect()
    by = {r.i: [tuple(x) for x in r.b] for r in got}
    assert [(i, by[i]) for i, t, s in rows if by[i] != brute(t, s)] == []
    assert {k for b in by.values() for k, _ in b} == {"name", "contact", "skillhead", "skills", "heading", "bullet", "body"}


def test_segments_join_to_the_text(spark):
    terms = ["go", "C++", "Node.js", "node", "SQL", "go lang"]
    rng = random.Random(2)
    pieces = ["Go", "go lang", "C++", "c+++", "node.js", "Node", ".node", "SQLite", "sql", " ", ", ", "é", "\n", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", None]
    pattern = re.compile(r"(?<![A-Za-z0-9+#.])(?:" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![A-Za-z0-9+#])", re.IGNORECASE | re.ASCII)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", resume.segments(F.col("t"), terms).alias("s"), resume.segments(F.col("t"), []).alias("none")).collect()
    for r in got:
        parts, at = [], 0
        for m in pattern.finditer(r.t or ""):
            parts += [(r.t[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
            at = m.end()
        parts += [((r.t or "")[at:], False)] * (at < len(r.t or ""))
        assert [tuple(x) for x in r.s] == parts and "".join(x.text for x in r.s) == (r.t or "")
        assert [tuple(x) for x in r.none] == ([(r.t, False)] if r.t else [])


def test_labels_with_letters_and_digits_as_borders(spark):
    lexicon = {"Go": ["go"], "REST": ["rest"], "C": ["c"], "C++": ["c++"]}
    cases = {"Go, .rest": ["Go", "REST"], "google restaurant": [], "c++": ["C", "C++"], None: [], "x-go-y C#": ["C", "Go"]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", resume.matched_labels(F.col("t"), lexicon).alias("m")).collect()
    assert {r.t: r.m for r in rows} == cases


@pytest.mark.parametrize("found,said", [(["B", "A", "Z"], "I know A, B, and d."), ([], "I know d, and B."), (["A", "B", "C", "D", "E", "F"], "I know A, B, C, D, and E."), (["C"], "I know C, d, and B.")])
def test_summary(spark, found, said):
    c = resume.summary(F.array(*map(F.lit, found)).cast("array<string>"), ["A", "B", "C", "D", "E", "F"], ["Delta", "B"], {"Delta": "d"}, "I know {stack}.")
    assert spark.range(1).select(c).first()[0] == said


def test_boxes_of_all_sizes_hold_what_they_hold(spark):
    rng = random.Random(7)
    points = [(i, rng.choice([None, float("nan"), rng.uniform(-3, 3), rng.randrange(-20, 20) * 0.13]), rng.uniform(-3, 3)) for i in range(300)]
    boxes = [(0, 0.0, 0.0, 0.0, 0.0), (1, -90.0, -180.0, 90.0, 180.0), (2, 1.0, 1.0, 0.0, 2.0), (3, None, 0.0, 1.0, 1.0), (4, -0.13, -3.0, 0.26, 3.0)]
    for i in range(5, 60):
        s, w, size = rng.uniform(-3, 3), rng.uniform(-3, 3), 10 ** rng.uniform(-3, 1)
        boxes.append((i, s, w, s + size * rng.random(), w + size * rng.random()))
    p, b = spark.createDataFrame(points, "ord long, latitude double, longitude double"), spark.createDataFrame(boxes, "area long, south double, west double, north double, east double")
    got = areas.inside(p, b)
    wanted = sorted((a, o) for a, s, w, n, e in boxes if s is not None for o, y, x in points if y is not None and s <= y <= n and w <= x <= e)
    assert sorted((r.area, r.ord) for r in got.collect()) == wanted and len(wanted) > 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__level" in plan and "Join Cross" not in plan
    assert areas.inside(p, b.limit(0)).collect() == areas.inside(p.limit(0), b).collect() == []


def test_businesses(spark):
    tags = [{"name": "a", "shop": ""}, {"name": "b", "building": "retail"}, {"name": "c", "building": "yes"}, {"shop": "x"}, {"name": "d", "landuse": "commercial"}, {"name": "e", "landuse": "farm"}, {"name": "f", "highway": "x"}, None]
    rows = [(i, t, 0.5, 0.5) for i, t in enumerate(tags)]
    box = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "area long, south double, west double, north double, east double")
    features = spark.createDataFrame(rows, "ord long, tags map<string,string>, latitude double, longitude double")
    assert [r.ord for r in areas.businesses(features, box).orderBy("ord").collect()] == [0, 1, 4]
    assert [r.ord for r in areas.businesses(features, box, 2).orderBy("ord").collect()] == [0, 1]


def test_upserts_in_any_order_give_one_table(spark, tmp_path):
    shape = "job_url string, cached_at timestamp, reason string, score_delta int"
    from datetime import datetime as at

    first = [("a", at(2024, 1, 1), "old", 1), ("b", at(2024, 1, 1), "b", 2), ("c", at(2024, 1, 5), "c", 3)]
    second = [("a", at(2024, 1, 2), "new", 4), ("c", at(2024, 1, 4), "stale", 5), ("d", at(2024, 1, 1), "d", 6), ("d", at(2024, 1, 1), "e", 0)]
    wanted = [("a", "new", 4), ("b", "b", 2), ("c", "c", 3), ("d", "e", 0)]
    for n, runs in enumerate(([first, second], [second, first], [first, second, second, first])):
        path = str(tmp_path / f"t{n}")
        assert feed.cached(spark, path) is None
        for rows in runs:
            feed.upsert(spark.createDataFrame(rows, shape), path, 3)
        feed.upsert(spark.createDataFrame([], shape), path, 3)
        table = feed.cached(spark, path)
        assert sorted((r.job_url, r.reason, r.score_delta) for r in table.collect()) == wanted
        jobs = spark.createDataFrame([("a",), ("b",), ("z",)], "job_url string")
        left = feed.to_analyse(jobs, table, F.lit("2024-01-08 12:00:00").cast("timestamp"))
        assert sorted(r.job_url for r in left.collect()) == ["b", "z"]
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "t0").rglob("*.parquet")}
    feed.upsert(spark.createDataFrame([("a", at(2024, 2, 1), "newest", 9)], shape), str(tmp_path / "t0"), 3)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t0").rglob("*.parquet")}
    assert any(f in after and after[f] == t for f, t in untouched.items()) and any(f not in after for f in untouched)


def test_first_of_an_area_are_the_first_of_all_inside(spark):
    rng = random.Random(9)
    points = [(i, rng.choice([rng.uniform(-3, 3), rng.randrange(-20, 20) * 0.13, rng.gauss(0, 0.1), None]), rng.choice([rng.uniform(-3, 3), 0.5, float("nan")])) for i in rng.sample(range(5000), 1500)]
    boxes = [(0, 0.0, 0.0, 0.0, 0.0), (1, -90.0, -180.0, 90.0, 180.0), (2, 1.0, 1.0, 0.0, 2.0), (3, None, 0.0, 1.0, 1.0), (4, -0.13, -3.0, 0.26, 3.0), (5, -0.13, -3.0, 0.26, 3.0), (5, 0.0, -1.0, 1.0, 1.0)]
    for i in range(6, 60):
        s, w, size = rng.uniform(-3, 3), rng.uniform(-3, 3), 10 ** rng.uniform(-2, 1)
        boxes.append((i, s, w, s + size * rng.random(), w + size * rng.random()))
    p = spark.createDataFrame([(*x, {"name": "a", "shop": ""}) for x in points], "ord long, latitude double, longitude double, tags map<string,string>")
    b = spark.createDataFrame(boxes, "area long, south double, west double, north double, east double")
    held = {}
    for a, s, w, n, e in boxes:
        held.setdefault(a, []).extend(o for o, y, x in points if None not in (s, y) and s <= y <= n and w <= x <= e)
    for most in (1, 3, 40, 2000):
        got = sorted((r.area, r.place, r.ord) for r in areas.businesses(p, b, most).collect())
        assert got == [(a, k, o) for a in sorted(held) for k, o in enumerate(sorted(held[a])[:most], 1)]


def joined_rows(df):
    """Rows out of the joins of a frame that was collected."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        if "Join" in plan.nodeName():
            rows.append(plan.metrics().apply("numOutputRows").value())
        todo += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


def test_boxes_meet_only_the_first_points_of_a_place(spark):
    p = spark.range(20_000).selectExpr("id AS ord", "map('name', 'a', 'shop', 'x') AS tags", "id % 2 * 0.1D AS latitude", "id % 5 * 0.1D AS longitude")
    b = spark.range(100).selectExpr("id AS area", "-1D AS south", "-1D AS west", "1D AS north", "1D AS east")
    found = areas.businesses(p, b, 3)
    assert sorted((r.area, r.ord) for r in found.collect()) == [(a, o) for a in range(100) for o in range(3)]
    assert 300 in joined_rows(found) and max(joined_rows(found)) == 300
