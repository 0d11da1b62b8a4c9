"""Queries that find companies on maps, in search results and on their pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text as T
from talus.operators import companies as C
from talus.operators import discovery as D
from talus.plans.adapters import COMPANIES, companies, view
from talus.plans.company_queries import _KEY, _any

#: Named map features, two numbers apart so that names and kinds meet in all ways.
FEATURES = """
SELECT c_custkey AS ord,
  CASE c_custkey % 5 WHEN 0 THEN 'Neural NLP' WHEN 1 THEN 'Softtech Systems' WHEN 2 THEN 'Hot Desk House' WHEN 3 THEN '' ELSE 'Plain Bakers' END AS name,
  CASE c_custkey % 23 WHEN 0 THEN 'coworking' WHEN 1 THEN 'it' WHEN 2 THEN 'company' WHEN 3 THEN 'lawyer' WHEN 4 THEN 'political_party' ELSE '' END AS office,
  CASE c_custkey % 23 WHEN 5 THEN 'bakery' ELSE '' END AS shop,
  CASE c_custkey % 23 WHEN 6 THEN 'clinic' WHEN 7 THEN 'college' WHEN 8 THEN 'bank' WHEN 9 THEN 'cafe' WHEN 10 THEN 'car_wash' WHEN 11 THEN 'parking'
    WHEN 12 THEN 'coworking_space' ELSE '' END AS amenity,
  CASE c_custkey % 23 WHEN 13 THEN 'hotel' WHEN 14 THEN 'theme_park' WHEN 15 THEN 'viewpoint' ELSE '' END AS tourism,
  CASE c_custkey % 23 WHEN 16 THEN 'gym' WHEN 17 THEN 'marina' WHEN 18 THEN 'park' ELSE '' END AS leisure,
  CASE c_custkey % 23 WHEN 19 THEN 'carpenter' ELSE '' END AS craft,
  CASE c_custkey % 23 WHEN 20 THEN 'commercial' WHEN 21 THEN 'industrial' WHEN 15 THEN 'retail' ELSE '' END AS building,
  CASE c_custkey % 3 WHEN 0 THEN 'https://site.org' ELSE '' END AS website,
  CASE c_custkey % 4 WHEN 0 THEN 'https://other.org' ELSE '' END AS url,
  CASE c_custkey % 2 WHEN 0 THEN 'Main street' ELSE '' END AS street, CASE c_custkey % 7 WHEN 0 THEN '' ELSE 'Old Town' END AS city,
  CASE c_custkey % 6 WHEN 0 THEN NULL ELSE 10.5 END AS lat, CASE c_custkey % 9 WHEN 0 THEN NULL ELSE 20.25 END AS center_lat
FROM customer
"""
#: Results of a web search.
RESULTS = """
SELECT s_suppkey AS ord,
  CASE s_suppkey % 4 WHEN 0 THEN 'https://www.linkedin.com/company/x' WHEN 1 THEN '' ELSE 'https://www.firm' || cast(s_suppkey % 30 AS string) || '.io/a?b=1' END AS url,
  CASE s_suppkey % 5 WHEN 0 THEN 'Top 10 firms | Nova Labs | home' WHEN 1 THEN 'Careers – Delta Data' WHEN 2 THEN 'Jobs in town'
    WHEN 3 THEN 'About us :: Orbit – blog' ELSE '' END AS title,
  CASE s_suppkey % 6 WHEN 0 THEN 'Nova Labs, again NOVA Labs. Backend Software' WHEN 1 THEN 'Delta Data Systems-- and The Big Solutions' WHEN 2 THEN 'A Services; Orbit Group Pvt Ltd'
    WHEN 3 THEN 'nothing here' WHEN 4 THEN 'Best Cloud Analytics or Kite&Co Networks' ELSE '' END || ' by Firm' || cast(s_suppkey % 40 AS string) || ' Infotech' AS content
FROM supplier
"""
SITES = """
SELECT page_id, url, html || CASE page_id % 5 WHEN 0 THEN ' <a href="/careers/now">x</a> jobs@site.org zed@site.org jobs@site.org '
  WHEN 1 THEN ' <a HREF="https://x.org/hiring">y</a> https://www.linkedin.com/company/abc. ' WHEN 2 THEN ' We are hiring. https://x.com/talus" a@b.co ' WHEN 3 THEN ' careers ' ELSE '' END AS html
FROM pages
"""


def map_companies(spark, d):
    f = view(spark, d, FEATURES, "customer")
    kept = ["name", "office", "shop", "amenity", "tourism", "leisure", "craft", "building", "website", "url"]
    pairs = [c for k in kept for c in (F.lit(k), F.col(k))] + [F.lit("addr:street"), F.col("street"), F.lit("addr:city"), F.col("city")]
    coordinates = [F.col("lat").cast("double").alias("lat"), F.col("lat").cast("double").alias("lon")]
    centre = [F.col("center_lat").cast("double").alias("center_lat"), F.col("center_lat").cast("double").alias("center_lon")]
    f = f.select("ord", F.concat(F.lit("node/"), F.col("ord").cast("string")).alias("osm_id"), F.create_map(*pairs).alias("tags"), *coordinates, *centre)
    return D.from_map(f, "map").select("ord", "company_name", "website", "google_maps", "address", "industry", "business_type", "technical_work", "non_technical_work", "coworking_name")


def harvested(spark, d):
    return D.harvest(view(spark, d, RESULTS, "supplier"), "Web").select("key", "ord", "company_name", "website", "industry")


def page_titles(spark, d):
    r = view(spark, d, RESULTS, "supplier")
    return r.select("ord", D.title_name(F.col("title")).alias("name"), F.array_join(D.names_in(F.col("content")), "|").alias("names"), D.is_directory(F.col("url")).alias("directory"))


def site_facts(spark, d):
    x = D.site_facts(F.col("html"), F.col("url"))
    social = F.array_join(F.transform(F.array_sort(F.map_keys(x["social_links"])), lambda k: F.concat(k, F.lit(" "), F.try_element_at(x["social_links"], k))), "|")
    return view(spark, d, SITES, "pages").select("page_id", *[F.array_join(x[c], "|").alias(c) for c in ("emails", "hr_emails")], social.alias("social"), x["careers"].alias("careers"), x["hiring"].alias("hiring"))


def parent_areas(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    place = F.concat(F.lit("Sector "), F.col("s_suppkey").cast("string"), F.element_at(F.array(F.lit(""), F.lit(", Old Town"), F.lit(", Old Town, North, Utopia"), F.lit(", Utopia")), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return s.select("s_suppkey", D.parent_area(place, "utopia").alias("parent"))


def names_unmatched(spark, d):
    """Names of all suppliers that no customer-made feature has; both tables whole."""
    known = view(spark, d, FEATURES, "customer").select(F.col("name").alias("company_name"))
    bare = F.regexp_replace("company_name", " [0-9]+$", "")
    found = companies(spark, d).select("ord", F.when(F.col("ord") % 2 == 0, "Plain Bakers Ltd").otherwise(bare).alias("company_name"))
    return C.name_only(found, known).select("ord", "key")


QUERIES = {f.__name__: f for f in (map_companies, harvested, page_titles, site_facts, parent_areas, names_unmatched)}


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_OFFICE = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in D.OFFICES.items())
_TECH = _list([k for k, v in D.OFFICES.items() if v[1]])
_TITLED = "upper({0}[1]) || replace({0}[2:], '_', ' ')"
_SHARED = f"(office = 'coworking' OR amenity = 'coworking_space' OR {_any('lower(name)', C.COWORKING)})"
_AI, _IT = f"shop = '' AND amenity = '' AND regexp_matches(name, '{C.AI_NAMES}')", "shop = '' AND amenity = '' AND " + _any("(' ' || lower(name) || ' ')", C.IT_NAMES)
_CLASS = f"""CASE WHEN {_SHARED} THEN 'Coworking Space|Coworking' WHEN office IN {tuple(D.OFFICES)} THEN (CASE office {_OFFICE} END) || '|Company / Office'
  WHEN {_AI} THEN 'AI / ML|Company / Office' WHEN {_IT} THEN 'IT / Software|Company / Office' WHEN office = 'company' THEN 'Company (general)|Company / Office'
  WHEN office <> '' THEN 'Office (' || office || ')|Company / Office' WHEN shop <> '' THEN 'Retail (' || shop || ')|Local Business / Retail'
  WHEN amenity = 'clinic' THEN 'Healthcare|Healthcare' WHEN amenity = 'college' THEN 'Education|Education' WHEN amenity = 'bank' THEN 'Finance / Banking|Company / Office'
  WHEN tourism = 'hotel' THEN 'Hospitality / Hotel|Local Business' WHEN leisure = 'gym' THEN 'Fitness / Leisure|Local Business' WHEN amenity = 'cafe' THEN 'Food & Beverage|Local Business / Retail'
  WHEN amenity = 'car_wash' THEN 'Car Wash|Local Business' WHEN amenity <> '' THEN {_TITLED.format('amenity')} || '|Local Business' WHEN tourism = 'theme_park' THEN 'Theme Park|Local Business'
  WHEN tourism <> '' THEN {_TITLED.format('tourism')} || '|Local Business' WHEN leisure <> '' THEN {_TITLED.format('leisure')} || '|Local Business'
  WHEN craft <> '' THEN 'Craft (' || craft || ')|Small Business' WHEN building IN ('commercial', 'office', 'retail') THEN 'Commercial Building|Building' WHEN building = 'industrial' THEN 'Industrial|Building'
  ELSE 'Business|Business' END"""
_NAMES = f"""list_filter(list_transform(regexp_extract_all(content, '{_quoted(D.COMPANY_NAME)}', 1), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'), ' .,-')),
  lambda v: length(v) BETWEEN 5 AND 60 AND contains(v, ' ') AND NOT list_contains({_list(D.NOT_FIRST)}, split_part(lower(v), ' ', 1)) AND NOT {_any('lower(v)', D.NOT_IN_NAMES)})"""
_DISTINCT = "list_filter(n, lambda v, i: list_position(list_transform(n, lambda w: lower(w)), lower(v)) = i)"
_NAME = f"""list_filter(list_transform(regexp_split_to_array(title, '{D.TITLE_PARTS}'), lambda v: trim(v)),
  lambda v: length(v) >= 3 AND NOT list_contains({_list(D.NOT_FIRST)}, split_part(lower(v), ' ', 1)) AND NOT regexp_matches(v, '{D.HEADING_TITLE}'))[1][1:80]"""
_R = "r AS (" + RESULTS.replace("cast(s_suppkey % 30 AS string)", "CAST(s_suppkey % 30 AS VARCHAR)") + ")"
_HOST = r"regexp_extract(regexp_replace(lower(url), '^https?://(www\.)?', ''), '^[^/]*', 0)"
_BARE = _KEY.replace("company_name", "name")
_WEB = f"CASE WHEN regexp_matches(name, '{C.AI_NAMES}') THEN 'AI / ML' WHEN {_any(chr(40) + chr(39) + ' ' + chr(39) + ' || lower(name) || ' + chr(39) + ' ' + chr(39) + chr(41), C.IT_NAMES)} THEN 'IT / Software' ELSE 'Web' END"
_SOCIALS = ", ".join(f"CASE WHEN regexp_matches(html, '{_quoted(p)}') THEN '{k} ' || regexp_replace(regexp_extract(html, '{_quoted(p)}', 0), '[\".,)]+$', '') END" for k, p in sorted(D.SOCIAL.items()))

ORACLE_SQL = {
    "map_companies": f"""WITH f AS ({FEATURES}), k AS (SELECT *, {_CLASS} AS class, CAST(coalesce(nullif(lat, 0), center_lat) AS DOUBLE) AS degrees,
      (NOT {_SHARED}) AND (list_contains({_TECH}, office) OR (office NOT IN {tuple(D.OFFICES)} AND (({_AI}) OR ({_IT})))) AS technical FROM f
      WHERE name <> '' AND (office <> '' OR shop <> '' OR craft <> '' OR building <> '' OR NOT (amenity = 'parking' OR leisure = 'park' OR tourism = 'viewpoint')))
      SELECT ord, name AS company_name, CASE WHEN website <> '' THEN website ELSE url END AS website, coalesce('https://www.google.com/maps/search/?api=1&query=' || degrees || ',' || degrees, '') AS google_maps,
      coalesce(array_to_string(list_filter([street, city], lambda v: v <> ''), ', '), '') AS address, split_part(class, '|', 1) AS industry, split_part(class, '|', 2) AS business_type, technical AS technical_work, NOT technical AS non_technical_work,
      CASE WHEN split_part(class, '|', 2) = 'Coworking' THEN name ELSE '' END AS coworking_name FROM k""",
    "harvested": f"""WITH {_R}, s AS (SELECT ord, -1 AS pos, {_NAME} AS name, split_part(url, '?', 1) AS website FROM (SELECT *, {_HOST} AS host FROM r) WHERE host <> '' AND NOT {_any('host', D.DIRECTORIES)} QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord) = 1),
      t AS (SELECT ord, {_NAMES.replace('(content,', '(title || chr(10) || content,')} AS n FROM r), m AS (SELECT ord, unnest({_DISTINCT}) AS name, generate_subscripts({_DISTINCT}, 1) AS pos FROM t),
      u AS (SELECT ord, pos, name, website FROM s WHERE name IS NOT NULL UNION ALL SELECT ord, pos, name, '' FROM m)
      SELECT {_BARE} AS key, ord, name AS company_name, website, {_WEB} AS industry FROM u QUALIFY row_number() OVER (PARTITION BY {_BARE} ORDER BY ord, pos) = 1""",
    "page_titles": f"WITH {_R}, t AS (SELECT ord, {_NAME} AS name, {_NAMES} AS n, {_any('lower(url)', D.DIRECTORIES)} AS directory FROM r) SELECT ord, name, coalesce(array_to_string({_DISTINCT}, '|'), '') AS names, directory FROM t",
    "site_facts": rf"""WITH p AS ({SITES}), e AS (SELECT *, list_sort(list_distinct(regexp_extract_all(html, '{T.EMAIL}', 0)))[1:8] AS emails, list_filter(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda v: regexp_matches(v, '{D.OPENINGS}'))[1] AS link FROM p)
      SELECT page_id, coalesce(array_to_string(emails, '|'), '') AS emails, coalesce(array_to_string(list_filter(emails, lambda v: regexp_matches(v, '{D.STAFF}')), '|'), '') AS hr_emails,
      coalesce(array_to_string(list_filter([{_SOCIALS}], lambda v: v IS NOT NULL), '|'), '') AS social,
      CASE WHEN link IS NULL THEN '' WHEN starts_with(link, 'http') THEN link ELSE rtrim(url, '/') || '/' || ltrim(link, '/') END AS careers, link IS NOT NULL OR contains(lower(html), 'hiring') OR contains(lower(html), 'careers') AS hiring FROM e""",
    "parent_areas": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'Old Town' WHEN 2 THEN 'Old Town,North' END AS parent FROM supplier",
    "names_unmatched": rf"""WITH c AS ({COMPANIES}), f AS ({FEATURES}), n AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN 'Plain Bakers Ltd' ELSE regexp_replace(company_name, ' [0-9]+$', '') END AS company_name FROM c),
      k AS (SELECT ord, {_KEY} AS key FROM n) SELECT min(ord) AS ord, key FROM k WHERE key <> '' AND key NOT IN (SELECT {_BARE} FROM f) GROUP BY key""",
}
