"""Queries over results of web searches, and views of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import companies as C
from talus.plans.adapters import COMPANIES, view
from talus.plans.company_queries import _BUSINESS, _COWORK, _KEY, _SIZE, _any, _records
from talus.plans.source_queries import _BODY, _first
from talus.sources import search_results as S
from talus.sources.payloads import POSTING

_URL = """CASE doc_id % 9 WHEN 0 THEN 'https://boards.greenhouse.io/a/' WHEN 1 THEN 'https://www.linkedin.com/posts/' WHEN 2 THEN 'https://x.org/blog/' WHEN 3 THEN 'https://x.org/careers/' WHEN 4 THEN 'https://jobs.lever.co/' WHEN 5 THEN 'https://LinkedIn.com/pulse/' WHEN 6 THEN '' ELSE 'https://x.org/jobs?' END
 || CASE WHEN doc_id % 9 = 6 THEN '' WHEN doc_id % 4 = 0 THEN 'same' ELSE cast(doc_id AS string) END"""
_TITLE = "CASE doc_id % 7 WHEN 0 THEN 'Dev at Acme - remote' WHEN 1 THEN 'Dev | Acme' WHEN 2 THEN '' WHEN 3 THEN ' Jane on LinkedIn: hi – x | y' WHEN 4 THEN 'Dev – Acme' ELSE 'Plain title' END"
RESULTS = f"""
SELECT doc_id AS ord, doc_id % 6 AS term_rank, 'node.js  bACKEND ' || CASE doc_id % 2 WHEN 0 THEN 'dev' ELSE 'x' END AS term, CASE doc_id % 3 WHEN 0 THEN 'Acme' ELSE 'Orbit' END AS company,
  CASE WHEN doc_id % 19 = 0 THEN '{{"results":[' ELSE '{{"results":[7,{{"url":"' || {_URL} || '","title":"' || {_TITLE} || '","content":"' || CASE doc_id % 5 WHEN 0 THEN 'Backend ' ELSE '' END || {_BODY} || '","published_date":"2024-01-02T00"}}]}}' END AS payload FROM documents
"""
KEYWORDS = ["Backend", "tionea"]


def _landed(spark, d):
    return view(spark, d, RESULTS.replace("{", "{{").replace("}", "}}"), "documents")


def search_web(spark, d):
    return S.web(_landed(spark, d))


def search_boards(spark, d):
    return S.boards(_landed(spark, d), "Pune")


def search_posts(spark, d):
    return S.hiring_posts(_landed(spark, d))


def search_careers(spark, d):
    return S.careers(_landed(spark, d), KEYWORDS)


def _enriched(spark, d):
    r = _records(spark, d).withColumn("industry", F.when(F.col("ord") % 4 == 0, "IT / Software").when(F.col("ord") % 4 == 1, "AI / ML").otherwise(F.col("industry")))
    return C.enriched(r.withColumn("business_type", F.lit("old")))


def company_view(spark, d):
    """Views by all conditions: software firms with a site and a text, and others by kind, industry and shared office."""
    r = _enriched(spark, d)
    views = [C.viewed(r, with_site=True, text="LABS"), C.viewed(r, False, shared=True), C.viewed(r, False, kind="Healthcare"), C.viewed(r, industry="AI / ML")]
    rows = [v.select(F.lit(i).alias("view"), "ord", "company_size", "business_type", "is_coworking_space") for i, v in enumerate(views)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def company_choices(spark, d):
    return C.choices(_enriched(spark, d))


def page_techniques(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    headers = F.when(F.col("page_id") % 3 == 0, "X-Powered-By: Express").when(F.col("page_id") % 3 == 1, "CF-Ray: 1 x-amz-id")
    page = F.concat("html", F.when(F.col("page_id") % 4 == 0, F.lit("<i ng-version=1 src=/a.PHP>")).otherwise(F.lit("")))
    return pages.select("page_id", F.array_join(C.techniques(page, headers), "|").alias("techniques"))


def space_tenants(spark, d):
    """The first shared offices of a map, and the firms that titles of results name."""
    sql = "SELECT c_custkey AS ord, CASE c_custkey % 9 WHEN 0 THEN 'Grand Tech Park' WHEN 1 THEN ' ab ' WHEN 2 THEN 'Desk' ELSE 'Shop' END || ' ' || cast(c_custkey AS string) AS name, CASE c_custkey % 9 WHEN 2 THEN 'coworking' WHEN 3 THEN 'it' ELSE '' END AS office FROM customer"
    features = view(spark, d, sql, "customer").select("ord", F.create_map(F.lit("name"), F.col("name"), F.lit("office"), F.col("office")).alias("tags"))
    titles = view(spark, d, "SELECT s_suppkey AS ord, CASE s_suppkey % 4 WHEN 0 THEN 'At Acme Data Systems, and Orbit-' || cast(s_suppkey % 30 AS string) || ' Tech' WHEN 1 THEN 'no firm' WHEN 2 THEN 'acme ltd, ACME Ltd' ELSE 'Nova Inc' END AS title FROM supplier", "supplier")
    spaces = C.shared_spaces(features).select(F.lit("space").alias("kind"), "ord", F.col("space").alias("name"))
    return spaces.unionByName(C.tenants(titles).select(F.lit("tenant").alias("kind"), "ord", F.col("company_name").alias("name")))


QUERIES = {f.__name__: f for f in (search_web, search_boards, search_posts, search_careers, company_view, company_choices, page_techniques, space_tenants)}

_R = f"""WITH s AS ({RESULTS}), v AS (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON->'results'->1 END AS j FROM s), r AS (SELECT ord * 2147483648 + 1 AS ord, term_rank, term, company AS firm, {_first('url')} AS url, {_first('title')} AS title, {_first('content')} AS content FROM v WHERE j IS NOT NULL)"""
_CUT = "CASE " + " ".join(f"WHEN contains(title, '{p}') THEN trim(split_part(title, '{p}', {{0}}))" for p in S.PARTS) + " ELSE {1} END"
_ONCE = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1"


def _chain(x: str, parts: list[str]) -> str:
    for p in parts:
        x = f"split_part({x}, '{p}', 1)"
    return x


def _select(rows: str, **c: str) -> str:
    c = {"title": "title", "company": "''", "location": "''", "date_posted": "''", "is_remote": "contains(lower(title || ' ' || content), 'remote')", "job_url": "url", "description": "content"} | c
    return f"{_R}, f AS ({rows}) SELECT ord, {', '.join(f'{c[k]} AS {k}' for k in POSTING[1:])} FROM f"


_SPLIT = f"SELECT ord, url, content, {_CUT.format(1, 'title')} AS title, {_CUT.format(2, chr(39) * 2)} AS company FROM r"
_IND = "CASE ord % 4 WHEN 0 THEN 'IT / Software' WHEN 1 THEN 'AI / ML' ELSE industry END"
_RECORDS = f"WITH c0 AS ({COMPANIES}), c AS (SELECT * REPLACE ({_IND} AS industry) FROM c0), e AS (SELECT *, {_SIZE} AS company_size, {_BUSINESS} AS business_type, {_COWORK} AS is_coworking_space FROM c)"
_TECH = ", ".join(f"CASE WHEN {_any('low', C.TECHNIQUES[k])} THEN '{k}' END" for k in sorted(C.TECHNIQUES))

ORACLE_SQL = {
    "search_web": _select(f"{_SPLIT} WHERE {_any('lower(url)', S.JOB_PLACES)} {_ONCE}", site="'tavily'", company="company"),
    "search_boards": _select(f"{_SPLIT} WHERE term_rank < 3 AND {_any('lower(url)', S.BOARDS)} {_ONCE}", site="'Career page (via Tavily)'", company="company", location="'Pune'"),
    "search_posts": _select(
        f"SELECT ord, url, content, {_chain('trim(title)', S.HEADLINE)} AS headline, 'Node.js Backend ' || CASE WHEN term LIKE '%dev' THEN 'Dev' ELSE 'X' END || ' — hiring post' AS title FROM r WHERE term_rank < 4 AND {_any('lower(url)', S.POSTS)} {_ONCE}",
        site="'LinkedIn post (via Tavily)'", company="coalesce(nullif(left(headline, 60), ''), '(LinkedIn post)')", location="'India'", date_posted="'2024-01-02'", description="left('LinkedIn hiring post' || CASE WHEN headline <> '' THEN ' — ' || headline ELSE '' END || '. ' || content, 1500)",
    ),
    "search_careers": _select(
        f"SELECT * FROM (SELECT ord, url, content, firm, {_chain('(CASE WHEN title = ' + chr(39) * 2 + ' THEN firm || ' + chr(39) + ' role' + chr(39) + ' ELSE title END)', S.CAREERS)} AS title FROM r) WHERE ({_any('lower(url)', ['greenhouse.io', 'lever.co'])} OR regexp_matches(lower(url), '/(jobs?|careers)/[^/?#]+')) AND {_any('lower(title || chr(32) || content)', ['backend', 'tionea'])} {_ONCE}",
        title="left(trim(title), 120)", company="firm", location="'—'", site="firm || ' careers (via Tavily)'",
    ),
    "company_view": _RECORDS + " " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS view, ord, company_size, business_type, is_coworking_space FROM e WHERE {w}"
        for i, w in enumerate(("industry IN ('IT / Software', 'AI / ML') AND website <> '' AND contains(lower(company_name || ' ' || industry || ' ' || address), 'labs')", "contains(lower(business_type), 'cowork')", "business_type = 'Healthcare'", "industry = 'AI / ML'"))
    ),
    "company_choices": f"{_RECORDS}, u AS (SELECT 'business_type' AS field, business_type AS value FROM e UNION ALL SELECT 'industry', industry FROM e) SELECT field, value, count(*) AS records FROM u WHERE value <> '' GROUP BY ALL",
    "page_techniques": f"""WITH p AS (SELECT page_id, lower(html || CASE page_id % 4 WHEN 0 THEN '<i ng-version=1 src=/a.PHP>' ELSE '' END || ' ' || CASE page_id % 3 WHEN 0 THEN 'X-Powered-By: Express' WHEN 1 THEN 'CF-Ray: 1 x-amz-id' ELSE '' END) AS low FROM pages)
      SELECT page_id, array_to_string(list_filter([{_TECH}], lambda v: v IS NOT NULL), '|') AS techniques FROM p""",
    "space_tenants": f"""WITH n AS (SELECT c_custkey AS ord, trim(CASE c_custkey % 9 WHEN 0 THEN 'Grand Tech Park' WHEN 1 THEN ' ab ' WHEN 2 THEN 'Desk' ELSE 'Shop' END || ' ' || c_custkey) AS name, c_custkey % 9 IN (0, 2) AS ok FROM customer),
      t AS (SELECT s_suppkey AS ord, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['At Acme Data Systems', 'Orbit-' || s_suppkey % 30 || ' Tech'] WHEN 2 THEN ['ACME Ltd'] WHEN 3 THEN ['Nova Inc'] ELSE [] END) AS company_name, unnest(CASE s_suppkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [] ELSE [1] END) AS n FROM supplier),
      f AS (SELECT ord, company_name FROM t QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ord, n) = 1)
      (SELECT 'space' AS kind, ord, name FROM n WHERE ok ORDER BY ord LIMIT 5) UNION ALL SELECT 'tenant', ord, company_name FROM f""",
}
