"""Queries over company records."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.text import company_key, slug
from talus.operators import companies as C
from talus.plans.adapters import COMPANIES, companies


def _records(spark, d):
    phones = F.when(F.col("has_phone"), F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    return companies(spark, d).withColumn("phones", phones).withColumn("source", F.array("src")).drop("has_phone", "src")


def company_classes(spark, d):
    return _records(spark, d).select("ord", C.size_class().alias("size_class"), C.business_type().alias("business"), C.is_coworking().alias("coworking"), C.confidence().cast("int").alias("confidence"))


def company_names(spark, d):
    return _records(spark, d).select("ord", company_key(F.col("company_name")).alias("company_key"), slug(F.col("company_name")).alias("slug"))


def company_merge(spark, d):
    return C.merge(_records(spark, d)).select("ord", "website", F.array_join("source", "|").alias("source"))


def company_merge_in_order(spark, d):
    return C.merge_in_order(_records(spark, d)).select("ord", "website", F.array_join("source", "|").alias("source"))


def company_name_only(spark, d):
    r = _records(spark, d)
    return C.name_only(r.where("ord % 2 = 0"), r.where("ord % 3 = 0")).select("ord", "key")


def company_boxes(spark, d):
    half = F.col("ord") % 30 / 100.0
    return _records(spark, d).where("latitude is not null").select("ord", *[F.round(v.cast("double"), 6).alias(k) for k, v in C.box(F.col("latitude").cast("double"), F.col("longitude").cast("double"), half.cast("double"), half.cast("double")).items()])


def company_types(spark, d):
    return _records(spark, d).groupBy(C.business_type().alias("business")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C.is_coworking()).alias("shared"))


def company_industries(spark, d):
    r = _records(spark, d).withColumn("industry", C.industry_for(F.col("company_name"), F.col("industry")))
    colour = C.map_colour(F.col("industry"), F.lit(""), F.lit(False))
    url = C.openings_url(F.when(F.col("ord") % 3 == 0, F.col("website")), F.col("company_name"), "https://jobs.example.org/search?q=")
    return r.select("ord", "industry", colour.alias("colour"), url.alias("openings"))


def company_order(spark, d):
    r = _records(spark, d).withColumn("industry", C.industry_for(F.col("company_name"), F.col("industry"))).withColumn("confidence", C.confidence())
    return C.best_first(r, 25).select("ord")


def company_sources(spark, d):
    return C.sources(C.merge(_records(spark, d)))


QUERIES = {f.__name__: f for f in (company_industries, company_order, company_sources, company_classes, company_names, company_merge, company_merge_in_order, company_name_only, company_boxes, company_types)}


def _any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


_T = "lower(company_name || ' ' || industry || ' ' || description || ' ' || address)"
_N, _A, _B, _W = "lower(company_name)", "lower(address)", "lower(building_name)", "lower(website)"
_NEW = f"contains({_N}, 'startup')"
_SIZE = f"""CASE WHEN {_any(_N, C.GIANTS)} THEN 'enterprise' WHEN {_any(_W, ['.com.au', '.co.uk', '.gov', '.edu'])} AND NOT {_NEW} THEN 'large'
 WHEN {_any(_N, ['corp', 'limited', 'ltd', 'inc', 'plc', 'sa'])} AND NOT {_any(_N, ['startup', 'incubator'])} THEN 'large'
 WHEN {_any(_A, ['tower', 'plaza', 'business park', 'corporate park', 'business centre', 'business center'])} AND NOT {_NEW} AND NOT contains({_A}, 'co-working') THEN 'large'
 WHEN {_any(_B, ['tower', 'plaza', 'park', 'centre', 'center', 'complex', 'hub'])} AND NOT {_NEW} THEN 'large'
 WHEN {_any(_N, ['startup', 'incubator', 'accelerator', 'labs', 'studio', 'garage'])} THEN 'startup' WHEN {_any(_W, ['.io', '.dev', '.ai', '.co'])} THEN 'startup'
 WHEN {_any(_A, ['incubator', 'accelerator', 'startup hub', 'startup space'])} THEN 'startup'
 WHEN {_any(_N, ['enterprise', 'group', 'global', 'international'])} OR {_any(_B, ['enterprise', 'global'])} THEN 'mid' ELSE 'small' END"""
_BUSINESS = "CASE " + " ".join(f"WHEN {_any(_T, v)} THEN '{k}'" for k, v in C.BUSINESS.items()) + " ELSE coalesce(nullif(lower(industry), ''), 'Other') END"
_COWORK = _any(f"({_T} || ' ' || {_B})", C.COWORKING)
_KEY = r"trim(regexp_replace(regexp_replace(lower(company_name), '\b(pvt\.?|private|limited|ltd\.?|llp|inc\.?|corp\.?|the)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_C = f"c AS ({COMPANIES})"
_MERGE = r"""s1 AS (SELECT *, CASE WHEN website <> '' THEN 'web ' || regexp_replace(regexp_replace(lower(website), '^https?://(www\.)?', ''), '/+$', '') ELSE 'row ' || ord END AS k FROM c),
 g1 AS (SELECT min(ord) AS ord, list_distinct(list(src)) AS source, arg_min(website, CASE WHEN website <> '' THEN ord END) AS website FROM s1 GROUP BY k),
 s2 AS (SELECT g1.*, CASE WHEN latitude IS NOT NULL THEN 'geo ' || lower(company_name) || '|' || format('{:.4f}|{:.4f}', CAST(latitude AS DOUBLE), CAST(longitude AS DOUBLE)) ELSE 'row ' || g1.ord END AS k FROM g1 JOIN c USING (ord))"""
_IND = f"""CASE WHEN regexp_matches(company_name, '{C.AI_NAMES}') THEN 'AI / ML' WHEN {_any("(' ' || lower(company_name) || ' ')", C.IT_NAMES)} THEN 'IT / Software' ELSE industry END"""
_CONF = """CAST(40 + (CASE WHEN website <> '' THEN 25 ELSE 0 END) + (CASE WHEN address <> '' THEN 10 ELSE 0 END) + (CASE WHEN has_phone THEN 10 ELSE 0 END) + (CASE WHEN ind NOT IN ('Unknown', '') THEN 10 ELSE 0 END) AS INTEGER)"""
_COLOUR = "CASE WHEN contains(lower(ind), 'cowork') THEN '#a78bfa' " + " ".join(f"WHEN {_any('lower(ind)', n)} THEN '{c}'" for n, c in C.KINDS) + " ELSE '#94a3b8' END"

ORACLE_SQL = {
    "company_industries": f"""WITH {_C}, i AS (SELECT *, {_IND} AS ind FROM c) SELECT ord, ind AS industry, {_COLOUR} AS colour,
      CASE WHEN ord % 3 = 0 AND website <> '' THEN website ELSE 'https://jobs.example.org/search?q=' || replace(company_name, ' ', '%20') END AS openings FROM i""",
    "company_order": f"""WITH {_C}, i AS (SELECT *, {_IND} AS ind FROM c) SELECT ord FROM i
      ORDER BY ind IN ('IT / Software', 'AI / ML') DESC, {_CONF} DESC, coalesce(latitude <> 0, FALSE) DESC, website <> '' DESC, ord LIMIT 25""",
    "company_sources": f"WITH {_C} SELECT DISTINCT src AS source FROM c",
    "company_classes": f"""WITH {_C} SELECT ord, {_SIZE} AS size_class, {_BUSINESS} AS business, {_COWORK} AS coworking,
      CAST(40 + (CASE WHEN website <> '' THEN 25 ELSE 0 END) + (CASE WHEN address <> '' THEN 10 ELSE 0 END) + (CASE WHEN has_phone THEN 10 ELSE 0 END) + (CASE WHEN industry NOT IN ('Unknown', '') THEN 10 ELSE 0 END) AS INTEGER) AS confidence FROM c""",
    "company_names": f"WITH {_C} SELECT ord, {_KEY} AS company_key, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c",
    "company_merge": f"WITH {_C}, {_MERGE} SELECT min(ord) AS ord, arg_min(website, CASE WHEN website <> '' THEN ord END) AS website, array_to_string(list_sort(list_distinct(flatten(list(source)))), '|') AS source FROM s2 GROUP BY k",
    "company_merge_in_order": f"""WITH RECURSIVE {_C}, r AS (SELECT *, row_number() OVER (ORDER BY ord) AS i,
        CASE WHEN website <> '' THEN 'web ' || rtrim(regexp_replace(lower(website), '^https?://(www\\.)?', ''), '/') END AS wk,
        CASE WHEN latitude <> 0 AND longitude <> 0 THEN 'geo ' || lower(trim(company_name)) || '|' || round_even(CAST(latitude AS DOUBLE), 4) || '|' || round_even(CAST(longitude AS DOUBLE), 4) END AS gk FROM c),
      f AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ks, []::BIGINT[] AS hs, 0::BIGINT AS ord, 0::BIGINT AS head
        UNION ALL SELECT i, CASE WHEN met IS NULL THEN ks || list_filter([wk, gk], lambda v: v IS NOT NULL) ELSE ks END, CASE WHEN met IS NULL THEN hs || list_transform(list_filter([wk, gk], lambda v: v IS NOT NULL), lambda v: ord) ELSE hs END, ord, coalesce(met, ord)
        FROM (SELECT r.i, r.ord, wk, gk, ks, hs, coalesce(hs[list_position(ks, wk)], hs[list_position(ks, gk)]) AS met FROM f JOIN r ON r.i = f.i + 1)),
      o AS (SELECT f.head, r.ord, r.website, r.src FROM f JOIN r USING (ord))
      SELECT head AS ord, coalesce(arg_min(website, CASE WHEN website <> '' THEN ord END), '') AS website, (SELECT string_agg(src, '|' ORDER BY seen) FROM (SELECT src, min(ord) AS seen FROM o p WHERE p.head = o.head GROUP BY src)) AS source FROM o GROUP BY head""",
    "company_name_only": f"WITH {_C} SELECT min(ord) AS ord, {_KEY} AS key FROM c WHERE ord % 2 = 0 AND {_KEY} <> '' AND {_KEY} NOT IN (SELECT {_KEY} FROM c WHERE ord % 3 = 0) GROUP BY 2",
    "company_boxes": f"""WITH {_C}, h AS (SELECT ord, CAST(latitude AS DOUBLE) AS a, CAST(longitude AS DOUBLE) AS b, greatest(0.02, least(0.13, ord % 30 / 100.0)) AS h FROM c WHERE latitude IS NOT NULL)
      SELECT ord, round(CAST(a - h AS DOUBLE), 6) AS south, round(CAST(b - h AS DOUBLE), 6) AS west, round(CAST(a + h AS DOUBLE), 6) AS north, round(CAST(b + h AS DOUBLE), 6) AS east FROM h""",
    "company_types": f"WITH {_C} SELECT {_BUSINESS} AS business, count(*) AS n, CAST(count(*) FILTER ({_COWORK}) AS BIGINT) AS shared FROM c GROUP BY 1",
}
