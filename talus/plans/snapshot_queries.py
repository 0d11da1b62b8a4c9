"""Queries that write and read feeds, export records, and read cards of HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import feed
from talus.plans.adapters import COMPANIES, POSTINGS, postings, view
from talus.plans.company_queries import _records
from talus.plans.posting_queries import _PROJECT
from talus.session import shared_path
from talus.sources import snapshots as S

_JOB = """'{"title":"Dev ' || cast(doc_id AS string) || '","company":' || CASE doc_id % 3 WHEN 0 THEN 'null' ELSE '"Acme"' END || ',"is_remote":' || CASE doc_id % 2 WHEN 0 THEN 'true' ELSE '"False"' END || ',"min_amount":' || cast(doc_id AS string) || '},5,{"job_url":"' || md5(text) || '"}'"""
#: Six snapshots of each feed: envelopes, lists, broken ones, nulls, and JSON that is neither.
SNAPSHOTS = f"""
SELECT doc_id // 6 AS feed, doc_id * 5 % 7 AS rank,
  CASE (doc_id + doc_id // 6) % 7 WHEN 0 THEN '{{"fetched_at":"2024-01-0' || cast(doc_id % 9 + 1 AS string) || '","count":9,"jobs":[' || {_JOB} || ']}}' WHEN 1 THEN '[' || {_JOB} || ']' WHEN 2 THEN '{{"jobs":[' || {_JOB}
    WHEN 3 THEN NULL WHEN 4 THEN '{{"fetched_at":"x"}}' WHEN 5 THEN '7' ELSE '[' || {_JOB} || ',' END AS payload
FROM documents
"""
CARDS = """
SELECT page_id AS ord, '<ul>' || CASE page_id % 5 WHEN 0 THEN '' ELSE '<LI class="x"><h3 class="a base-search-card__title"> Dev &amp; <b> Ops </b>' || cast(page_id AS string) || ' </h3><h4 class=''base-search-card__subtitle''> <a href="/firm">Acme</a> </h4><span class="job-search-card__location">'
  || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' Remote, India ' ELSE 'Pune' END || '</span><a class="base-card__full-link x" href="' || url || '">go</a></LI>' END
  || '<li><div class="base-search-card__title">No link</div></li><li><a href="https://x.org/?q=1">no title</a></li>' || CASE page_id % 2 WHEN 0 THEN '<li><p class="base-search-card__title">Any link</p><a id="1" href="https://any.org/a?b=1&amp;c">z</a></li>' ELSE '' END || '</ul>' AS payload
FROM pages
"""
ROWS = 150


def _spark_sql(sql: str) -> str:
    """DuckDB's whole division, and marks of the SQL of views, in Spark's words."""
    return sql.replace("doc_id // 6", "doc_id div 6").replace("{", "{{").replace("}", "}}")


def read_feeds(spark, d):
    return S.feeds(view(spark, d, _spark_sql(SNAPSHOTS), "documents"))


def feed_round_trip(spark, d):
    """A feed that is written as one envelope and read back, behind a path that is not there and one that is broken."""
    path, broken = shared_path(spark, "feed"), shared_path(spark, "broken-feed")
    spark.createDataFrame([('{"jobs": [',)], "value string").coalesce(1).write.text(broken)
    feed.write_feed(feed.project(postings(spark, d), "2024-01-30 06:00").withColumn("ord", F.col("title")), path, "2024-01-30", [F.desc("title"), F.asc("job_url"), F.asc("company"), F.asc("site"), F.asc("date_posted"), F.asc("location"), F.asc("min_amount"), F.asc("max_amount"), F.asc("company_num_employees"), F.asc("is_remote")], ROWS)
    return S.feeds(S.snapshot_files(spark, [f"{path}-none", broken, path])).drop("feed")


def company_csv(spark, d):
    records = _records(spark, d).withColumn("address", F.when(F.col("ord") % 4 == 0, F.concat("address", F.lit(' "x"\n'))).when(F.col("ord") % 4 == 1, F.lit(None)).otherwise(F.col("address")))
    return feed.csv_lines(records.withColumn("source", F.array(F.lit("map"), F.lit("web"))), ["company_name", "website", "industry", "address", "phones", "source"], ["ord"])


def page_cards(spark, d):
    return S.cards(view(spark, d, CARDS, "pages"), "India", 3)


QUERIES = {f.__name__: f for f in (read_feeds, feed_round_trip, company_csv, page_cards)}

_FEED_COLUMNS = ", ".join(f"coalesce(j->>'{c}', '') AS {c}" for c in feed.COLUMNS)
_CELL = lambda x: f"CASE WHEN regexp_matches({x}, '[\",\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"

ORACLE_SQL = {
    "read_feeds": f"""WITH s AS ({SNAPSHOTS}), b AS (SELECT feed, rank, payload::JSON AS v FROM s WHERE json_valid(payload) QUALIFY row_number() OVER (PARTITION BY feed ORDER BY rank, payload DESC) = 1),
      l AS (SELECT feed, rank, CASE json_type(v) WHEN 'OBJECT' THEN v->>'fetched_at' END AS fetched_at, CASE json_type(v) WHEN 'ARRAY' THEN v WHEN 'OBJECT' THEN v->'jobs' END AS l FROM b),
      i AS (SELECT feed, rank, fetched_at, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS n FROM l), j AS (SELECT feed, CAST(rank AS BIGINT) AS rank, fetched_at, CAST(n AS INTEGER) AS n, json_extract(l, '$[' || n || ']') AS j FROM i)
      SELECT feed, rank, fetched_at, n, {_FEED_COLUMNS} FROM j WHERE json_type(j) = 'OBJECT'""",
    "feed_round_trip": f"""WITH p AS ({POSTINGS}), f AS (SELECT {_PROJECT} FROM p), o AS (SELECT *, row_number() OVER (ORDER BY title DESC, job_url, company, site, date_posted, location, min_amount, max_amount, company_num_employees, is_remote) - 1 AS n FROM f)
      SELECT CAST(2 AS INTEGER) AS rank, '2024-01-30' AS fetched_at, CAST(n AS INTEGER) AS n, {', '.join(feed.COLUMNS)} FROM o WHERE n < {ROWS}""",
    "company_csv": f"""WITH c AS ({COMPANIES}), a AS (SELECT *, coalesce(CASE ord % 4 WHEN 0 THEN address || ' "x"' || chr(10) WHEN 1 THEN NULL ELSE address END, '') AS addr FROM c)
      SELECT ord, concat_ws(',', {_CELL('company_name')}, {_CELL('website')}, {_CELL('industry')}, {_CELL('addr')}, CASE WHEN has_phone THEN '1' ELSE '' END, 'map; web') AS line FROM a""",
    "page_cards": f"""WITH c AS (SELECT page_id, url, page_id % 5 = 0 AS plain FROM pages),
      u AS (SELECT page_id * 2147483648 AS ord, 'Dev &Ops' || page_id AS title, 'Acme' AS company, CASE page_id % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'Remote, India' ELSE 'Pune' END AS location, page_id % 3 = 1 AS is_remote, split_part(replace(url, '&amp;', '&'), '?', 1) AS job_url FROM c WHERE NOT plain
        UNION ALL SELECT page_id * 2147483648 + 2, 'Any link', '', 'India', FALSE, 'https://any.org/a' FROM c WHERE plain AND page_id % 2 = 0)
      SELECT ord, title, company, location, 'LinkedIn (public)' AS site, '' AS date_posted, is_remote, job_url, title AS description FROM u""",
}
