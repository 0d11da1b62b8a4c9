"""Queries over resume text, areas of a map, and the table of analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import areas as A
from talus.operators import companies as C
from talus.operators import feed
from talus.operators import resume as R
from talus.plans.adapters import POSTINGS, postings, view
from talus.plans.text_queries import LEXICON, tags_sql
from talus.session import shared_path

#: Documents as resumes whose heads differ.
RESUMES = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Jane Roe' || chr(10) || ' ' || chr(10) || '+1 555 123 4567 | x' || chr(10) || 'GitHub.com/x' || chr(10) || 'a@b.org' || chr(10)
  WHEN 1 THEN chr(10) || 'Jane Roe' || chr(13) || chr(10) || 'SUMMARY:' || chr(10) || 'a@b.org' || chr(10) || '• shipped it ' || chr(10) || '-- no bullet' || chr(10) WHEN 2 THEN 'Jane' || chr(10) || 'x@y.org' || chr(10) || 'plain' || chr(10) || 'late@y.org' || chr(10)
  WHEN 3 THEN 'ONE' || chr(10) WHEN 4 THEN 'J' || chr(10) || 'http://CV.ORG' || chr(10) || '  Work Experience : ' || chr(10) || '* a' || chr(9) || chr(10) WHEN 5 THEN 'J' || chr(10) || 'MAIL: A@B.ORG' || chr(10) || 'Mostly CAPS IN HERE' || chr(10) ELSE '' END
  || CASE doc_id % 9 WHEN 0 THEN '' ELSE text END AS body
FROM documents
"""
POINTS = """
SELECT c_custkey AS ord, CASE c_custkey % 11 WHEN 0 THEN '' ELSE 'Firm' END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'shop' WHEN 1 THEN 'building' WHEN 2 THEN 'landuse' WHEN 3 THEN 'highway' ELSE 'tourism' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'retail' ELSE 'yes' END AS what,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(10 + c_custkey * 7 % 100 / 100.0 + 0.003 AS double) END AS latitude, cast(c_custkey * 11 % 60 / 100.0 - 0.297 AS double) AS longitude
FROM customer
"""
BOXES = """
SELECT s_suppkey AS area, cast(10 + s_suppkey * 13 % 100 / 100.0 AS double) AS lat, cast(s_suppkey * 17 % 60 / 100.0 - 0.3 AS double) AS lon, cast(s_suppkey % 25 / 100.0 AS double) AS half_lat,
  cast(s_suppkey % 7 / 50.0 AS double) AS half_lon FROM supplier
"""
TERMS = ["the", "der", "and the", "una", "THE"]
PRIORITY, DEFAULT, SHORT = ["Link", "Article", "Plus", "Place", "Ending"], ["Ending", "Java", "Link"], {"Ending": "End", "Java": "J"}
SUMMARY = "Engineer who knows {stack} well."
NOTE = "Dear {company},\n\nI apply for {role} with {years} years and {skills}.\n{name}"
PERSON = {"years": "3", "name": "Jane Roe"}
MOST = 3


def resume_blocks(spark, d):
    rows = view(spark, d, RESUMES, "documents")
    skills = F.when(F.col("doc_id") % 2 == 0, "Go, SQL").otherwise("")
    return rows.select("doc_id", F.posexplode(R.blocks(F.col("body"), skills)).alias("n", "b")).select("doc_id", "n", "b.kind", "b.text")


def bold_runs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cut = docs.withColumn("runs", R.segments(F.col("text"), TERMS))
    marked = F.array_join(F.transform("runs", lambda x: F.when(x["bold"], F.concat(F.lit("<b>"), x["text"], F.lit("</b>"))).otherwise(x["text"])), "")
    return cut.select("doc_id", marked.alias("marked"), (F.array_join(F.transform("runs", lambda x: x["text"]), "") == F.col("text")).alias("whole"))


def application_text(spark, d):
    """What a job asks for, as the summary and the note of an application."""
    jobs = spark.read.parquet(f"{d}/documents.parquet").withColumn("labels", R.matched_labels(F.col("text"), LEXICON))
    note = R.cover_note(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" Dev "), F.col("lang"))), F.when(F.col("doc_id") % 4 > 0, F.col("source")).otherwise(""), F.col("labels"), PERSON, NOTE)
    return jobs.select("doc_id", F.array_join("labels", "|").alias("found"), R.summary(F.col("labels"), PRIORITY, DEFAULT, SHORT, SUMMARY).alias("summary"), note.alias("note"))


def area_businesses(spark, d):
    """Features of a map inside each of many areas, the first few of each."""
    points = view(spark, d, POINTS, "customer")
    tags = F.map_filter(F.create_map(F.lit("name"), F.nullif("name", F.lit("")), F.col("kind"), F.col("what")), lambda _, v: v.isNotNull())
    boxes = view(spark, d, BOXES, "supplier").select("area", *[v.alias(k) for k, v in C.box(F.col("lat"), F.col("lon"), F.col("half_lat"), F.col("half_lon")).items()])
    return A.businesses(points.select("ord", tags.alias("tags"), "latitude", "longitude"), boxes, MOST).select("area", "ord", "place")


def analyses_table(spark, d):
    """Three runs into one table, the last with stale rows, and the second again."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    p = postings(spark, d).where("job_url <> ''").select("ord", "job_url")
    p = p.groupBy("job_url").agg(F.min("ord").alias("ord"))
    run = lambda rows, at, delta: rows.select("job_url", at.alias("cached_at"), F.lit("run").alias("reason"), (F.col("ord") % delta).cast("int").alias("score_delta"))
    runs = [run(p.where("ord % 3 < 2"), day(5), 7), run(p.where("ord % 2 = 0"), day(F.lit(4) + (F.col("ord") % 4).cast("int")), 11), run(p, day(3), 13)]
    path = shared_path(spark, "analyses")
    for rows in (*runs, runs[1]):
        feed.upsert(rows, path, 8)
    return feed.cached(spark, path).select("key", F.unix_timestamp("cached_at").alias("cached_at"), "score_delta")


QUERIES = {f.__name__: f for f in (resume_blocks, bold_runs, application_text, area_businesses, analyses_table)}

_WORDS = ", ".join(f"'{x}'" for x in R.SECTIONS)
_SIGNS = ", ".join(f"'{x}'" for x in R.BULLETS)
_TITLE = "trim(rtrim(line, ':'))"
_HEAD = f"""(length({_TITLE}) BETWEEN 1 AND 40 AND (lower({_TITLE}) IN ({_WORDS}) OR (regexp_matches({_TITLE}, '\\pL') AND len(string_split_regex({_TITLE}, '\\s+')) <= 5
   AND 10 * length(regexp_replace({_TITLE}, '[^\\p{{Lu}}]', '', 'g')) >= 8 * length(regexp_replace({_TITLE}, '[^\\pL]', '', 'g')))))"""
_CONTACT = r"(contains(line, '@') OR contains(line, '|') OR regexp_matches(lower(line), 'http|linkedin|github|\+?[0-9][0-9\s()\-]{7,}'))"
_BORDER = "'<b>\\1</b>\\2'"

ORACLE_SQL = {
    "resume_blocks": f"""WITH r AS ({RESUMES}), l AS (SELECT doc_id, unnest(string_split_regex(body, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85]')) AS raw, generate_subscripts(string_split_regex(body, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85]'), 1) AS at_line FROM r),
      k AS (SELECT doc_id, trim(raw, ' ' || chr(9)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY at_line) AS k FROM l WHERE trim(raw, ' ' || chr(9)) <> ''),
      c AS (SELECT *, {_HEAD} AS head, {_CONTACT} AS about FROM k), w AS (SELECT *, lag(about AND NOT head) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c),
      b AS (SELECT doc_id, k AS pos, CASE WHEN k = 1 THEN 'name' WHEN (k = 2 OR (k = 3 AND before)) AND about AND NOT head THEN 'contact' WHEN head THEN 'heading' WHEN left(line, 1) IN ({_SIGNS}) AND left(line, 2) <> '--' THEN 'bullet' ELSE 'body' END AS kind, line FROM w),
      s AS (SELECT doc_id, pos, kind, CASE kind WHEN 'heading' THEN upper(rtrim(line, ':')) WHEN 'bullet' THEN trim(substr(line, 2), ' ' || chr(9)) ELSE line END AS text FROM b
        UNION ALL SELECT doc_id, 3.1, 'skillhead', 'KEY SKILLS FOR THIS ROLE' FROM r WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3.2, 'skills', 'Go, SQL' FROM r WHERE doc_id % 2 = 0)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'name' THEN 0 WHEN kind = 'contact' THEN 1 WHEN kind IN ('skillhead', 'skills') THEN 2 ELSE 3 END, pos) - 1 AS INTEGER) AS n, kind, text FROM s""",
    "bold_runs": f"""SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '(?i)(and) the', '\\1\x01the', 'g'), '[A-Za-z0-9+#.\x01]+|[^A-Za-z0-9+#.\x01]+'),
        lambda t: replace(CASE WHEN regexp_matches(t, '(?i)^(and\x01the|the|der|una)(\\.|$)') THEN regexp_replace(t, '(?i)^(and\x01the|the|der|una)(\\.|$)', {_BORDER})
          WHEN regexp_matches(t, '(?i)\x01the(\\.|$)') THEN regexp_replace(t, '(?i)\x01(the)(\\.|$)', '\x01<b>\\1</b>\\2')
          ELSE t END, '\x01', ' ')), ''), '') AS marked, TRUE AS whole FROM documents""",
    "application_text": f"""WITH t AS (SELECT *, {tags_sql('text').replace('[^a-z0-9+#.]', '[^a-z0-9]').replace('[^a-z0-9+#]', '[^a-z0-9]')} AS f FROM documents),
      p AS (SELECT *, list_filter(['Link', 'Article', 'Plus', 'Place', 'Ending'], lambda x: list_contains(f, x)) AS lead FROM t),
      q AS (SELECT *, list_transform(CASE WHEN len(lead) < 3 THEN lead || list_filter(['Ending', 'Java', 'Link'], lambda x: NOT list_contains(lead, x)) ELSE lead END, lambda x: CASE x WHEN 'Ending' THEN 'End' WHEN 'Java' THEN 'J' ELSE x END)[1:5] AS s FROM p)
      SELECT doc_id, coalesce(array_to_string(f, '|'), '') AS found, 'Engineer who knows ' || CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], ', ') || ', and ' || s[len(s)] ELSE s[1] END || ' well.' AS summary,
        'Dear ' || CASE WHEN doc_id % 4 > 0 THEN source ELSE 'your team' END || ',' || chr(10) || chr(10) || 'I apply for ' || CASE WHEN doc_id % 3 > 0 THEN 'Dev ' || lang ELSE 'this role' END || ' with 3 years and '
          || CASE WHEN len(f) > 0 THEN array_to_string(f[1:5], ', ') ELSE 'backend and API development' END || '.' || chr(10) || 'Jane Roe' AS note FROM q""",
    "area_businesses": f"""WITH p AS ({POINTS}), b AS (SELECT area, lat - greatest(0.02, least(0.13, half_lat)) AS s, lat + greatest(0.02, least(0.13, half_lat)) AS n, lon - greatest(0.02, least(0.13, half_lon)) AS w, lon + greatest(0.02, least(0.13, half_lon)) AS e FROM ({BOXES}))
      SELECT area, ord, CAST(row_number() OVER (PARTITION BY area ORDER BY ord) AS INTEGER) AS place FROM p JOIN b ON latitude BETWEEN s AND n AND longitude BETWEEN w AND e
      WHERE name <> '' AND (kind IN ('shop', 'tourism') OR (kind = 'building' AND what IN ('commercial', 'retail')) OR (kind = 'landuse' AND what = 'commercial')) QUALIFY place <= {MOST}""",
    "analyses_table": f"""WITH p AS ({POSTINGS}), u AS (SELECT job_url, min(ord) AS ord FROM p WHERE job_url <> '' GROUP BY job_url),
      a AS (SELECT job_url, 5 AS d, ord % 7 AS score_delta FROM u WHERE ord % 3 < 2 UNION ALL SELECT job_url, 4 + ord % 4, ord % 11 FROM u WHERE ord % 2 = 0 UNION ALL SELECT job_url, 3, ord % 13 FROM u)
      SELECT md5(job_url) AS key, CAST(epoch(TIMESTAMP '2024-01-01') + d * 86400 AS BIGINT) AS cached_at, CAST(score_delta AS INTEGER) AS score_delta FROM a QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY d DESC, score_delta DESC) = 1""",
}
