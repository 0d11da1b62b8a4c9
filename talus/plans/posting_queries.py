"""Queries that gate, score, rank and carry postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.plan import computed_once
from talus.functions.text import stated_years as least_stated
from talus.operators import feed, filters, rank, scoring
from talus.operators.lexicon import tags
from talus.plans.adapters import POSTINGS, postings
from talus.plans.text_queries import tags_sql

SKILLS = {"C++": ["c++"], "Docker": ["docker"], "Go": ["go"], "Java": ["java"], "Python": ["python"], "REST": ["rest"], "SQL": ["sql"], "Spring": ["spring"]}
PROFILE = scoring.Profile(titles=["Backend Developer", "Python Engineer"], skills=["Docker", "Java", "Python", "SQL"], domains={"Ending": ["tionea"]}, home=["de"], big_companies=[" acme ", "hooli"], years=2, pay=7.0)
TARGETS = ["Java", "Python", "SQL"]
K = 20


def as_of():
    """The day of all these queries; a column needs a session, so none is made on import."""
    return F.lit("2024-01-30").cast("date")


def as_of_time():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def _scored(spark, d):
    return scoring.match_score(postings(spark, d), SKILLS, PROFILE, as_of())


def _kept(spark, d, ratio=0.6, least=0):
    df = _scored(spark, d).where(F.col("reason").isNull() & (F.coalesce("skill_ratio", F.lit(1.0)) >= ratio) & (F.col("score") >= least))
    return rank.first_wins(df.drop("description"), "job_url", drop_blank=True)


def match_score(spark, d):
    return _scored(spark, d).select("ord", F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"), "score", "reason")


def generic_score(spark, d):
    return scoring.generic_score(postings(spark, d), SKILLS, TARGETS, PROFILE, as_of()).select("ord", F.array_join("matched", "|").alias("matched"), "base", "score")


def title_relevance(spark, d):
    return postings(spark, d).select("ord", scoring.title_relevance(F.col("title"), PROFILE.titles).alias("relevance"))


def facts(spark, d):
    df = scoring.add_facts(postings(spark, d), SKILLS, PROFILE, as_of())
    return df.select("ord", "least_years", "most_years", "employees", "pay", "days", scoring.recency_boost(F.col("days")).alias("recency"), scoring.pay_boost(F.col("pay"), 7.0).alias("boost"), scoring.level_of(F.col("least_years")).alias("level"))


def _signals():
    """(delta, fit) of a description."""
    return scoring.signals(F.col("description"), [r"\bbe\b", r"\bthe\b", r"\b2\s*-\s*3\s*years?\b"], [r"\bof\b", r"\bto\b", r"\bsich\b"], [r"\bwe\s+(?:mentor|coach|guide)\b"])


def signal_delta(spark, d):
    return computed_once(postings(spark, d).select("ord", _signals().alias("s"))).select("ord", "s.delta", "s.fit")


def top_postings(spark, d):
    return rank.top(_kept(spark, d), K).select("ord", "title", "site", "score", "days")


def diversified(spark, d):
    return rank.diversify(_kept(spark, d), K).select("place", "ord", "site", "score")


def relax_and_retry(spark, d):
    """Strict gates, or relaxed ones where they keep too few: both are flags of one scored plan."""
    ok, ratio = F.col("reason").isNull(), F.coalesce("skill_ratio", F.lit(1.0))
    df = rank.relax(_scored(spark, d), ok & (ratio >= 0.9) & (F.col("score") >= 95), ok & (ratio >= 0.5), 500)
    return rank.first_wins(df.drop("description"), "job_url", drop_blank=True).select("ord", "score", "was_relaxed")


def first_wins(spark, d):
    return rank.first_wins(postings(spark, d), "job_url").select("ord", "job_url")


def near_first(spark, d):
    return rank.near_first(postings(spark, d), "fr").select("ord", "tier")


def page_two(spark, d):
    return rank.page(_kept(spark, d), 2, 15).select("ord", "score")


def _reasons(spark, d):
    p = computed_once(postings(spark, d).withColumn("asked", tags(F.col("description"), SKILLS)))
    return computed_once(p.withColumn("reason", filters.strict_reason(F.col("title"), F.col("description"), F.col("asked"), ["Docker", "Java", "Python", "Spring"], ["Java", "Python"], 2)).select("ord", "job_url", "reason"))


def strict_gates(spark, d):
    return _reasons(spark, d).select("ord", "reason")


def reject_histogram(spark, d):
    r = _reasons(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return r.orderBy(F.desc("n"), "first_ord").limit(3).select("reason", "n")


def simple_filters(spark, d):
    p = postings(spark, d)
    keep = filters.age_within(F.col("date_posted"), as_of_time(), 240) & filters.level_fits(F.col("title"), "JUNIOR") & filters.is_true(F.col("is_remote"))
    return p.where(keep).select("ord", filters.is_posting_url(F.concat(F.lit("https://x.org/jobs/"), F.col("site"))).alias("posting"))


def feed_projection(spark, d):
    return feed.project(postings(spark, d), "2024-01-30 06:00")


def _before(spark, d):
    p = feed.project(postings(spark, d).where("ord % 3 <> 0"), "x").withColumn("site", F.when(F.col("site") < "src2", "Via Tavily").otherwise(F.col("site")))
    return p.withColumn("date_fetched", F.when(F.col("date_posted") == "", "").otherwise(F.concat("date_posted", F.lit(" 05:00"))))


def _today(spark, d):
    return feed.project(postings(spark, d).where("ord % 3 = 0"), "2024-01-30 06:00")


def carry_forward(spark, d):
    return feed.carry_forward(_today(spark, d), _before(spark, d), as_of_time(), 12).select("date_fetched", "site", "job_url")


def top_up(spark, d):
    return feed.top_up(_today(spark, d), _before(spark, d), 10_000_000).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def rejoined(spark, d):
    return feed.rejoin(_kept(spark, d).select("job_url"), postings(spark, d)).select("job_url", "ord", "title")


def with_analyses(spark, d):
    a = postings(spark, d).where("ord % 5 = 0 and job_url <> ''").groupBy("job_url").agg(F.max("ord").alias("score_delta"))
    return feed.with_analyses(_kept(spark, d).select("ord", "job_url"), a).select("ord", "score_delta")


def to_analyse(spark, d):
    p = postings(spark, d)
    cache = p.where("ord % 2 = 0").select(F.md5("job_url").alias("key"), F.try_to_timestamp("date_posted").alias("cached_at"))
    return feed.to_analyse(p, cache, as_of_time(), 7).select("ord", "key")


def generic_top(spark, d):
    scored = scoring.generic_score(postings(spark, d), SKILLS, TARGETS, PROFILE, as_of()).select("ord", "job_url", "matched", "base", "score", "days")
    return rank.generic_top(scored, True, K).select("ord", "base", "score")


def strict_stats(spark, d):
    return rank.strict_stats(_reasons(spark, d))


def reranked(spark, d):
    kept = computed_once(_scored(spark, d).where("reason is null").select("ord", "score", "days", _signals()["delta"].alias("delta")))
    return rank.rerank(kept, K).select("ord", "delta", "score")


def delta_counts(spark, d):
    return rank.delta_counts(signal_delta(spark, d))


def score_labels(spark, d):
    s = F.col("score")
    return _scored(spark, d).select("ord", scoring.step(s, scoring.LABELS).alias("label"), scoring.step(s, scoring.COLOURS).alias("colour"))


def stated_years(spark, d):
    return postings(spark, d).select("ord", least_stated(F.col("description")).alias("years"))


QUERIES = {
    f.__name__: f
    for f in (
        match_score, generic_score, title_relevance, facts, signal_delta, top_postings, diversified, relax_and_retry, first_wins, near_first,
        page_two, strict_gates, reject_histogram, simple_filters, feed_projection, carry_forward, top_up, rejoined, with_analyses, to_analyse,
        generic_top, strict_stats, reranked, delta_counts, score_labels, stated_years,
    )
}

_P = f"p AS ({POSTINGS})"
_YEARS = r"list_filter(list_transform(regexp_extract_all(title || ' ' || description, '(?i)(\d{1,2})\s*\+?\s*(?:years|yrs|yr)\b', 1), lambda v: CAST(v AS INTEGER)), lambda v: v <= 20)"
_DESC_YEARS = _YEARS.replace("title || ' ' || description", "description")
_AMOUNT = "coalesce(nullif(try_cast(max_amount AS DOUBLE), 0), try_cast(min_amount AS DOUBLE), 0)"
_REL = """CASE WHEN list_has_any(w, ['backend', 'python']) THEN 1.0 WHEN list_has_any(w, ['developer','engineer','programmer','sde','architect','dev']) THEN 0.3 ELSE 0.0 END"""
_FACTS = rf"""f AS (SELECT *, {tags_sql("(title || ' ' || description)", SKILLS)} AS skills, coalesce(list_min({_YEARS}), 0) AS least_years, coalesce(list_max({_YEARS}), 0) AS most_years,
 regexp_matches(title, '{filters.SENIOR}') AS senior, regexp_matches(title, '{filters.JUNIOR}') AS junior, regexp_extract_all(lower(title), '[a-z+#.]+') AS w,
 coalesce(try_cast(regexp_extract(replace(company_num_employees, ',', ''), '\d+', 0) AS INTEGER), 0) AS employees,
 contains(' ' || lower(company) || ' ', ' acme ') OR contains(lower(company), 'hooli') AS big,
 CASE WHEN interval = 'hourly' THEN 0.0 WHEN {_AMOUNT} * (CASE WHEN interval = 'monthly' THEN 12 ELSE 1 END) >= 100000 THEN {_AMOUNT} * (CASE WHEN interval = 'monthly' THEN 12 ELSE 1 END) / 100000 ELSE 0.0 END AS pay,
 CASE WHEN date_posted = '' THEN 9999 ELSE CAST(greatest(date_diff('day', CAST(date_posted AS DATE), DATE '2024-01-30'), 0) AS INTEGER) END AS days FROM p),
g AS (SELECT *, {_REL} AS relevance, CASE WHEN days <= 1 THEN 12 WHEN days <= 3 THEN 8 WHEN days <= 7 THEN 4 WHEN days <= 14 THEN 1 ELSE 0 END AS recency,
 CASE WHEN pay > 7 THEN least(15, CAST(round_even((pay - 7) * 2, 0) AS INTEGER)) ELSE 0 END AS boost, lower(title || ' ' || description) AS low FROM f)"""
_HAVE = "['Docker','Java','Python','SQL']"
_SCORED = rf"""{_P}, {_FACTS}, h AS (SELECT *, list_filter(skills, lambda v: list_contains({_HAVE}, v)) AS matched, list_filter(skills, lambda v: NOT list_contains({_HAVE}, v)) AS missing FROM g),
k AS (SELECT *, CASE WHEN len(skills) > 0 THEN len(matched) / len(skills) END AS skill_ratio FROM h),
s AS (SELECT *, greatest(0, least(100, CAST(round_even(coalesce(skill_ratio * 50, 6.0) + (CASE WHEN least_years = 0 THEN 12 WHEN least_years <= 2 THEN 20 WHEN least_years <= 3 THEN 8 ELSE 0 END)
 + (CASE WHEN junior THEN 8 ELSE 0 END) + relevance * 15 + (CASE WHEN relevance >= 0.8 THEN 10 ELSE 0 END) + (CASE WHEN contains(low, 'tionea') THEN 10 ELSE 0 END)
 + (CASE WHEN contains(lower(location), 'de') OR contains(low, 'de') THEN (CASE WHEN regexp_matches(low, '\b(hybrid|work[\s-]?from[\s-]?office|wfo|on[\s-]?site|in[\s-]?office)\b') THEN 13 ELSE 10 END) WHEN is_remote THEN 3 ELSE 0 END)
 + (CASE WHEN employees >= 500 THEN 6 WHEN employees >= 150 THEN 3 ELSE 0 END) + (CASE WHEN big THEN 6 ELSE 0 END) + boost + recency, 0) AS INTEGER))) AS score,
 CASE WHEN least_years > 3 THEN 'too many years' WHEN senior AND NOT junior THEN 'senior title' WHEN relevance = 0 THEN 'unrelated title' END AS reason FROM k)"""
_KEPT = f"{_SCORED}, kept AS (SELECT * FROM s WHERE reason IS NULL AND coalesce(skill_ratio, 1.0) >= 0.6 AND job_url <> '' QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord) = 1)"
_STRICT = f"""CASE WHEN {' OR '.join(f"contains(lower(title), '{x}')" for x in filters.WRONG_FIELD)} THEN 'wrong field'
 WHEN coalesce(list_min({_DESC_YEARS}), 0) > 3 THEN 'asks for ' || CAST(coalesce(list_min({_DESC_YEARS}), 0) AS VARCHAR) || ' years'
 WHEN NOT ({' OR '.join(f"contains(lower(title), '{x}')" for x in filters.ROLE_WORDS)}) THEN 'unrelated role'
 WHEN len(k) = 0 AND NOT starter THEN 'no known skills'
 WHEN NOT list_has_any(k, ['Docker','Java','Python','Spring']) THEN 'no skill overlap'
 WHEN len(list_filter(k, lambda v: list_contains(['Docker','Java','Python','Spring'], v))) = 1 AND NOT list_has_any(k, ['Java','Python']) THEN 'one minor skill' END"""
_REASONS = f"{_P}, t AS (SELECT *, {tags_sql('description', SKILLS)} AS k, contains(lower(title), 'sde') OR contains(lower(title), 'entry') OR contains(lower(title), 'junior') AS starter FROM p), r AS (SELECT ord, job_url, {_STRICT} AS reason FROM t)"
_TEXT = {"is_remote": "CASE WHEN is_remote THEN 'True' ELSE 'False' END", "date_fetched": "'2024-01-30 06:00'", "search_term": "''"}
_PROJECT = ", ".join(f"{_TEXT.get(c, c)} AS {c}" for c in feed.COLUMNS)
_FEED = f"""{_P}, today AS (SELECT {_PROJECT} FROM p WHERE ord % 3 = 0), before AS (SELECT CASE WHEN date_posted = '' THEN '' ELSE date_posted || ' 05:00' END AS date_fetched, CASE WHEN site < 'src2' THEN 'Via Tavily' ELSE site END AS site, job_url FROM p WHERE ord % 3 <> 0)"""


def _signal(column: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(lower({column}), '{x}') AS INTEGER)" for x in patterns)


_J, _S, _M = _signal("description", [r"\bbe\b", r"\bthe\b", r"\b2\s*-\s*3\s*years?\b"]), _signal("description", [r"\bof\b", r"\bto\b", r"\bsich\b"]), _signal("description", [r"\bwe\s+(?:mentor|coach|guide)\b"])

ORACLE_SQL = {
    "match_score": f"WITH {_SCORED} SELECT ord, coalesce(array_to_string(matched, '|'), '') AS matched, coalesce(array_to_string(missing[1:6], '|'), '') AS missing, score, reason FROM s",
    "generic_score": f"""WITH {_P}, {_FACTS}, h AS (SELECT *, list_filter(skills, lambda v: list_contains(['Java','Python','SQL'], v)) AS matched FROM g), b AS (SELECT *, CAST(round_even(least(len(matched), 3) * 100 / 3, 0) AS INTEGER) AS base FROM h)
      SELECT ord, coalesce(array_to_string(matched, '|'), '') AS matched, base, CAST(greatest(0, least(100, base + (CASE WHEN most_years = 0 THEN 0 WHEN most_years <= 3 THEN 10 ELSE -least(45, (most_years - 2) * 8) END) + (CASE WHEN senior THEN -20 ELSE 0 END)
      + (CASE WHEN is_remote THEN 8 ELSE 0 END) + (CASE WHEN employees >= 500 THEN 12 WHEN employees >= 150 THEN 6 ELSE 0 END) + (CASE WHEN big THEN 10 ELSE 0 END) + boost + recency)) AS INTEGER) AS score FROM b""",
    "title_relevance": f"WITH {_P}, {_FACTS} SELECT ord, CAST(relevance AS DOUBLE) AS relevance FROM g",
    "facts": f"WITH {_P}, {_FACTS} SELECT ord, least_years, most_years, employees, CAST(pay AS DOUBLE) AS pay, days, recency, boost, CASE WHEN least_years <= 2 THEN 'JUNIOR' WHEN least_years <= 5 THEN 'MID' WHEN least_years <= 8 THEN 'SENIOR' ELSE 'LEAD' END AS level FROM g",
    "signal_delta": rf"""WITH {_P}, c AS (SELECT *, {_J} AS j, {_S} AS s, {_M} AS m, try_cast(regexp_extract(description, '(?i)([0-9]{{1,2}})\s*(?:lpa|l|lakhs?|rupees?|₹)', 1) AS INTEGER) AS pay FROM p),
      r AS (SELECT *, (CASE WHEN j >= 2 THEN 12 WHEN j = 1 THEN 6 ELSE 0 END) - (CASE WHEN s >= 2 THEN 10 ELSE 0 END) + (CASE WHEN m >= 1 AND s >= 1 THEN 8 ELSE 0 END) + (CASE WHEN pay BETWEEN 5 AND 12 THEN 3 WHEN pay > 15 THEN -5 ELSE 0 END) AS raw, length(trim(description)) < 50 AS short FROM c)
      SELECT ord, CASE WHEN short THEN 0 WHEN s >= 3 THEN -20 ELSE greatest(-20, least(15, raw)) END AS delta, CASE WHEN short THEN NULL WHEN s >= 3 THEN FALSE WHEN raw > 5 THEN TRUE WHEN raw < -5 THEN FALSE END AS fit FROM r""",
    "top_postings": f"WITH {_KEPT} SELECT ord, title, site, score, days FROM kept ORDER BY score DESC, days, ord LIMIT {K}",
    "diversified": f"""WITH {_KEPT}, t AS (SELECT * FROM kept ORDER BY score DESC, days, ord LIMIT {4 * K}), u AS (SELECT *, row_number() OVER w AS turn, first_value(days) OVER w AS d1, first_value(ord) OVER w AS o1 FROM t WINDOW w AS (PARTITION BY score, site ORDER BY days, ord)),
      v AS (SELECT *, row_number() OVER (ORDER BY score DESC, turn, d1, o1) AS place FROM u) SELECT CAST(place AS INTEGER) AS place, ord, site, score FROM v WHERE place <= {K}""",
    "relax_and_retry": f"""WITH {_SCORED}, n AS (SELECT count(*) < 500 AS was_relaxed FROM s WHERE reason IS NULL AND coalesce(skill_ratio, 1.0) >= 0.9 AND score >= 95),
      q AS (SELECT s.*, was_relaxed FROM s, n WHERE reason IS NULL AND job_url <> '' AND ((coalesce(skill_ratio, 1.0) >= 0.9 AND score >= 95) OR (was_relaxed AND coalesce(skill_ratio, 1.0) >= 0.5)))
      SELECT ord, score, was_relaxed FROM q QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord) = 1""",
    "first_wins": f"WITH {_P} SELECT min(ord) AS ord, job_url FROM p GROUP BY job_url",
    "near_first": f"WITH {_P} SELECT ord, CASE WHEN contains(lower(location), 'fr') OR contains(lower(title), 'fr') THEN 0 ELSE 1 END AS tier FROM p WHERE contains(lower(location), 'fr') OR contains(lower(title), 'fr') OR is_remote",
    "page_two": f"WITH {_KEPT} SELECT ord, score FROM kept ORDER BY score DESC, days, ord LIMIT 15 OFFSET 15",
    "strict_gates": f"WITH {_REASONS} SELECT ord, reason FROM r",
    "reject_histogram": f"WITH {_REASONS} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY count(*) DESC, min(ord) LIMIT 3",
    "simple_filters": f"WITH {_P} SELECT ord, TRUE AS posting FROM p WHERE (date_posted = '' OR CAST(date_posted AS DATE) >= DATE '2024-01-20') AND NOT regexp_matches(title, '{filters.SENIOR_SEARCH}') AND is_remote",
    "feed_projection": f"WITH {_P} SELECT {_PROJECT} FROM p",
    "carry_forward": f"""WITH {_FEED} SELECT date_fetched, site, job_url FROM today UNION ALL SELECT date_fetched, site, job_url FROM before WHERE site = 'Via Tavily' AND job_url NOT IN (SELECT job_url FROM today)
      AND (date_fetched = '' OR floor(date_diff('second', CAST(date_fetched || ':00' AS TIMESTAMP), TIMESTAMP '2024-01-30 00:00:00') / 86400) <= 12)""",
    "top_up": f"WITH {_FEED} SELECT site, count(*) AS n FROM (SELECT site FROM today UNION ALL SELECT site FROM before WHERE job_url NOT IN (SELECT job_url FROM today)) GROUP BY site",
    "rejoined": f"WITH {_KEPT}, l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord DESC) = 1) SELECT l.job_url, l.ord, l.title FROM kept JOIN l USING (job_url)",
    "with_analyses": f"WITH {_KEPT}, a AS (SELECT job_url, max(ord) AS score_delta FROM p WHERE ord % 5 = 0 AND job_url <> '' GROUP BY job_url) SELECT kept.ord, coalesce(a.score_delta, 0) AS score_delta FROM kept LEFT JOIN a USING (job_url)",
    "to_analyse": f"WITH {_P} SELECT ord, md5(job_url) AS key FROM p WHERE md5(job_url) NOT IN (SELECT md5(job_url) FROM p WHERE ord % 2 = 0 AND date_posted <> '' AND date_diff('second', CAST(date_posted AS TIMESTAMP), TIMESTAMP '2024-01-30 00:00:00') < 7 * 86400)",
}

_DELTAS, _LABEL = f"({ORACLE_SQL['signal_delta']})", "CASE " + " ".join(f"WHEN score >= {n} THEN '{x}'" for n, x in scoring.LABELS[:-1]) + f" ELSE '{scoring.LABELS[-1][1]}' END"
_COLOUR = "CASE " + " ".join(f"WHEN score >= {n} THEN '{x}'" for n, x in scoring.COLOURS[:-1]) + f" ELSE '{scoring.COLOURS[-1][1]}' END"
ORACLE_SQL |= {
    "generic_top": f"""WITH {_P}, z AS (SELECT ord, job_url, base, score, days, CASE WHEN matched = '' THEN 0 ELSE len(string_split(matched, '|')) END AS hits
      FROM ({ORACLE_SQL["generic_score"]}) JOIN (SELECT ord, days FROM ({ORACLE_SQL["facts"]})) USING (ord) JOIN (SELECT ord, job_url FROM p) USING (ord) WHERE job_url <> ''),
      n AS (SELECT count(*) FILTER (hits >= 2 OR base >= 60) AS enough FROM z),
      q AS (SELECT z.* FROM z, n WHERE base >= 60 OR hits >= (CASE WHEN enough < 5 THEN 1 ELSE 2 END) QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord) = 1)
      SELECT ord, base, score FROM q ORDER BY score DESC, days, ord LIMIT {K}""",
    "strict_stats": f"WITH {_REASONS} SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, count(DISTINCT job_url) FILTER (reason IS NOT NULL) AS rejected FROM r",
    "reranked": f"WITH {_SCORED} SELECT s.ord, delta, score FROM s JOIN {_DELTAS} AS d ON s.ord = d.ord WHERE reason IS NULL ORDER BY delta DESC, days, score DESC, s.ord LIMIT {K}",
    "delta_counts": f"SELECT count(*) FILTER (delta > 0) AS boosted, count(*) FILTER (delta < 0) AS penalised FROM {_DELTAS}",
    "score_labels": f"WITH {_SCORED} SELECT ord, {_LABEL} AS label, {_COLOUR} AS colour FROM s",
    "stated_years": rf"""WITH {_P} SELECT ord, coalesce(list_min(list_filter(list_transform(regexp_extract_all(description, '(?i)([0-9]+)\s*[+-]?[^\n]*?years?', 1), lambda v: try_cast(v AS INTEGER)), lambda v: v <= 20)), 0) AS years FROM p""",
}
