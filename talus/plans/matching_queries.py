"""Queries that gate postings by what they ask for, rank a feed to its end, and tailor texts to all jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions.plan import computed_once
from talus.functions.text import stated_years
from talus.operators import feed, filters, rank
from talus.operators import resume as R
from talus.plans import posting_queries as Q
from talus.plans.adapters import postings
from talus.plans.text_queries import LEXICON, tags_sql

CORE, MAJOR = ["Docker", "Java", "Python", "Spring"], ["Java", "Python"]
AT_LEAST, MOST, ANALYSED, FLOOR = 500, 400, 100, 450


def _asking(spark, d):
    """Postings whose sections start early, late or not at all."""
    text = F.when(F.col("ord") % 3 == 1, F.concat(F.lit("Must have: docker \n\n"), F.col("description"))).when(F.col("ord") % 3 == 2, F.substring("description", 8, 1_000_000_000))
    p = postings(spark, d).withColumn("description", text.otherwise(F.col("description")))
    return computed_once(p.withColumn("asked", filters.required_skills(F.col("description"), Q.SKILLS)).withColumn("needed", stated_years(F.col("description"))))


def required_gates(spark, d):
    reason = filters.strict_reason(F.col("title"), F.col("description"), F.col("asked"), CORE, MAJOR, 2, F.col("needed"))
    return _asking(spark, d).select("ord", F.array_join("asked", "|").alias("asked"), "needed", reason.alias("reason"))


def ranked_feed(spark, d):
    """Gate, relax, rank by score, analyse the first, order by analysis and age, then fill from the rest up to a floor."""
    ok, ratio = F.col("reason").isNull(), F.coalesce("skill_ratio", F.lit(1.0))
    fits = F.contains(F.lower("description"), F.lit("python"))
    rows = feed.ranked(Q._scored(spark, d), postings(spark, d), ok & (ratio >= 0.6), ok & (ratio >= 0.34), Q._signals()["delta"], fits, Q.as_of(), AT_LEAST, MOST, ANALYSED, FLOOR)
    return rows.select("ord", "place", "delta", "filled")


def match_jobs(spark, d):
    return rank.run(Q._scored(spark, d), 30)[0].select("place", "ord", "site", "score")


def match_rejected(spark, d):
    return rank.run(Q._scored(spark, d), 30)[1]


def match_summary(spark, d):
    """A run that keeps enough by its strict gates, and one that has to relax them."""
    scored = Q._scored(spark, d)
    both = [rank.run(scored, k, at_least=n)[2].withColumn("k", F.lit(k)) for k, n in ((30, 15), (1_000_000, 1_000_000))]
    return both[0].unionByName(both[1])


def tailor_all(spark, d):
    """Every document against one job text, and every job text used: documents are dealt over the row numbers of the items."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    jobs = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("text").alias("job"), "item_id")
    numbers = jobs.select("item_id").withColumn("nth", F.row_number().over(Window.orderBy("item_id")) - 1)  # ids alone
    jobs, n = jobs.join(numbers, "item_id"), jobs.count()
    dealt = docs.withColumn("nth", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(max(n, 1))))
    out = R.tailor(F.col("text"), F.col("job"), F.lit("c++ and"), LEXICON)
    lines = dealt.join(jobs, "nth").select("doc_id", "item_id", *[v.alias(k) for k, v in out.items()])
    parts = {k: F.col(k) for k in out}
    return lines.select("doc_id", "item_id", R.skills_line(parts).alias("line"), R.skills_line(parts, True).alias("whole_line"))


def search_terms(spark, d):
    skills = F.split(F.lit("Go,Rust,go,SQL,C"), ",")
    terms = R.search_terms(F.concat("title", F.lit(", "), F.col("company"), F.lit(";; ")), F.array("title", F.lit("Data Analyst"), F.lit("x")), skills)
    return postings(spark, d).select("ord", F.array_join(terms, "|").alias("terms"), F.array_join(R.longest_first(terms), "|").alias("longest"))


QUERIES = {f.__name__: f for f in (required_gates, ranked_feed, match_jobs, match_rejected, match_summary, tailor_all, search_terms)}

_TEXT = "CASE ord % 3 WHEN 1 THEN 'Must have: docker ' || chr(10) || chr(10) || description WHEN 2 THEN substring(description, 8) ELSE description END"


def _section(start: str) -> str:
    window = f"substring(description, strpos(lower(description), '{start}'), {filters.SECTION})"
    stops = [f"strpos(lower({window}), " + ("chr(10) || chr(10)" if x == "\n\n" else f"'{x}'") + ")" for x in filters.SECTION_STOPS]
    cut = "least(" + ", ".join(f"CASE WHEN {x} > 1 THEN {x} END" for x in stops) + ")"
    return f"CASE WHEN strpos(lower(description), '{start}') > 0 THEN left({window}, coalesce({cut} - 1, {filters.SECTION})) || chr(10) ELSE '' END"


_PLAIN = ", ".join(rf"CASE WHEN regexp_matches(lower(part), '(^|[^\p{{L}}\p{{N}}_])(?:{p})([^\p{{L}}\p{{N}}_]|$)') THEN '{k}' END" for k, p in filters.PLAIN_SKILLS.items())
_SECTIONS = " || ".join(map(_section, filters.SECTION_STARTS))
_ASKING = rf"""{Q._P}, a AS (SELECT * REPLACE ({_TEXT} AS description) FROM p), b AS (SELECT *, {_SECTIONS} AS found FROM a), c AS (SELECT *, CASE WHEN found <> '' THEN found ELSE left(description, {filters.OPENING}) END AS part FROM b),
 e AS (SELECT *, {tags_sql('part', Q.SKILLS)} AS tagged, list_sort(list_filter([{_PLAIN}], lambda v: v IS NOT NULL)) AS plain FROM c),
 t AS (SELECT *, CASE WHEN len(tagged) > 0 THEN tagged ELSE plain END AS k, contains(lower(title), 'sde') OR contains(lower(title), 'entry') OR contains(lower(title), 'junior') AS starter,
  coalesce(list_min(list_filter(list_transform(regexp_extract_all(description, '(?i)([0-9]+)\s*[+-]?[^\n]*?years?', 1), lambda v: try_cast(v AS INTEGER)), lambda v: v <= 20)), 0) AS needed FROM e)"""
_REASON = Q._STRICT.replace(f"coalesce(list_min({Q._DESC_YEARS}), 0)", "needed")



def _why(ratio: float, least: int) -> str:
    whole = round(ratio * 100)
    return f"CASE WHEN skill_ratio < {ratio} THEN 'skills ' || CAST(round_even(skill_ratio * 100, 0) AS INTEGER) || '% of {whole}%' WHEN reason IS NOT NULL THEN reason WHEN score < {least} THEN 'score ' || score || ' of {least}' END"


_RUN = f"{Q._SCORED}, why_rows AS (SELECT s.ord, p.title, p.company, p.site, s.job_url, s.score, s.days, {_why(0.6, 50)} AS w1, {_why(0.5, 0)} AS w2 FROM s JOIN p ON p.ord = s.ord WHERE s.job_url <> '')"

ORACLE_SQL = {
    "match_jobs": f"""WITH {_RUN}, t AS (SELECT *, first_value(ord) OVER (PARTITION BY job_url ORDER BY ord) = ord AS lead FROM why_rows WHERE w1 IS NULL), b AS (SELECT * FROM t WHERE lead ORDER BY score DESC, days, ord LIMIT 120),
      u AS (SELECT *, row_number() OVER z AS turn, first_value(days) OVER z AS d1, first_value(ord) OVER z AS o1 FROM b WINDOW z AS (PARTITION BY score, site ORDER BY days, ord)), v AS (SELECT *, row_number() OVER (ORDER BY score DESC, turn, d1, o1) AS place FROM u)
      SELECT CAST(place AS INTEGER) AS place, ord, site, score FROM v WHERE place <= 30""",
    "match_rejected": f"WITH {_RUN} SELECT ord, title, company, site, w1 AS reason FROM why_rows WHERE w1 IS NOT NULL ORDER BY ord LIMIT 40",
    "match_summary": f"""WITH {_RUN}, n AS (SELECT count(*) AS fetched FROM p) SELECT n.fetched, CAST(least(30, count(DISTINCT job_url) FILTER (w1 IS NULL)) AS BIGINT) AS kept, count(*) FILTER (w1 IS NOT NULL) AS rejected_count, FALSE AS relaxed, CAST(0.6 AS DOUBLE) AS min_ratio, CAST(30 AS INTEGER) AS k FROM why_rows, n GROUP BY fetched
      UNION ALL SELECT n.fetched, count(DISTINCT job_url) FILTER (w2 IS NULL), count(*) FILTER (w2 IS NOT NULL), TRUE, CAST(0.5 AS DOUBLE), 1000000 FROM why_rows, n GROUP BY fetched""",
    "required_gates": f"WITH {_ASKING} SELECT ord, coalesce(array_to_string(k, '|'), '') AS asked, needed, {_REASON} AS reason FROM t",
    "ranked_feed": f"""WITH {Q._SCORED}, open_rows AS (SELECT *, coalesce(skill_ratio, 1.0) AS r FROM s WHERE reason IS NULL AND job_url <> ''),
      few AS (SELECT count(DISTINCT job_url) < {AT_LEAST} AS thin FROM open_rows WHERE r >= 0.6),
      firsts AS (SELECT open_rows.* FROM open_rows, few WHERE r >= 0.6 OR (thin AND r >= 0.34) QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord) = 1),
      best AS (SELECT job_url, row_number() OVER (ORDER BY score DESC, days, ord) AS rank FROM firsts QUALIFY rank <= {MOST}),
      lasts AS (SELECT job_url, max(ord) AS ord FROM p GROUP BY job_url), ages AS (SELECT ord, days FROM ({Q.ORACLE_SQL["facts"]})),
      judged AS (SELECT lasts.ord, rank, ages.days, CASE WHEN rank <= {ANALYSED} THEN d.delta ELSE 0 END AS delta FROM best JOIN lasts USING (job_url) JOIN {Q._DELTAS} AS d ON d.ord = lasts.ord JOIN ages ON ages.ord = lasts.ord),
      others AS (SELECT min(ord) AS ord FROM p WHERE contains(lower(description), 'python') AND job_url <> '' AND job_url NOT IN (SELECT job_url FROM best) GROUP BY job_url)
      SELECT ord, CAST(row_number() OVER (ORDER BY delta DESC, days, rank) AS INTEGER) AS place, delta, FALSE AS filled FROM judged
      UNION ALL SELECT ord, CAST((SELECT count(*) FROM best) + more AS INTEGER), 0, TRUE FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS more FROM others) WHERE more <= {FLOOR} - (SELECT count(*) FROM best)""",
    "tailor_all": f"""WITH t AS (SELECT d.doc_id, b.item_id, {tags_sql('d.text', LEXICON)} AS have, {tags_sql('b.text', LEXICON)} AS asked, {tags_sql("'c++ and'", LEXICON)} AS typed
      FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
      u AS (SELECT *, list_filter(asked, lambda v: list_contains(have, v)) || list_filter(typed, lambda v: NOT list_contains(have, v)) AS line FROM t)
      SELECT doc_id, item_id, coalesce(array_to_string(line, ', '), '') AS line, coalesce(array_to_string(line || list_filter(asked, lambda v: NOT list_contains(have, v) AND NOT list_contains(typed, v)), ', '), '') AS whole_line FROM u""",
    "search_terms": f"""WITH {Q._P}, a AS (SELECT ord, [title, company] || (CASE WHEN title = 'Data Analyst' THEN [] ELSE ['Data Analyst'] END) || ['Go', 'Rust', 'SQL'] AS terms FROM p)
      SELECT ord, array_to_string(terms[1:6], '|') AS terms, array_to_string(list_transform(list_sort(list_transform(terms[1:6], lambda v, i: {{'n': -length(v), 'i': i, 'x': v}})), lambda v: v.x), '|') AS longest FROM a""",
}
