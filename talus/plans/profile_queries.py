"""Queries over candidates' profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.plan import computed_once
from talus.functions.text import EMAIL
from talus.operators import ats as A
from talus.operators import profile as P
from talus.operators.lexicon import alias_map as lexicon_map
from talus.plans.adapters import view
from talus.plans.text_queries import LEXICON, _ordered, _points
from talus.plans.text_queries import ORACLE_SQL as TEXT_SQL

HOME = "Pune"
DEFAULT = ["software engineer", "backend developer"]
#: Documents as resumes, with typed inputs.
CANDIDATES = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Jane Roe' WHEN 1 THEN '  jane roe' WHEN 2 THEN 'Jane R0e' WHEN 3 THEN 'Ada B. van Stone' WHEN 4 THEN 'A B C D E' WHEN 5 THEN '' ELSE 'x@y.org' END || chr(10)
  || CASE doc_id % 5 WHEN 0 THEN 'Full Stack and Backend work, SDE 1' WHEN 1 THEN 'python, Golang' WHEN 2 THEN 'nothing' WHEN 3 THEN 'Machine Learning for payments and hospitals' ELSE 'DevOps in retail, B2B' END || chr(10)
  || CASE doc_id % 4 WHEN 0 THEN ' B.Tech, Town ' || chr(10) || 'MBA' || chr(10) WHEN 1 THEN 'embassy' || chr(10) ELSE '' END || CASE doc_id % 3 WHEN 0 THEN 'AWS Certified x' || chr(10) || 'certifiedly' || chr(10) || 'Certification: z' || chr(10) ELSE '' END
  || CASE doc_id % 6 WHEN 0 THEN 'At Acme Data Labs since 2020' || chr(10) || 'acme labs, Acme Data Labs' || chr(10) || 'Orbit & Co Pvt Ltd' || chr(10) WHEN 1 THEN 'for Big-Firm Consulting, 4+ years' || chr(10) ELSE '' END
  || CASE doc_id % 8 WHEN 0 THEN 'Call (+49 30 1234567-8) or 555 12' || chr(10) WHEN 1 THEN '20 yrs, 7 YEARS' || chr(10) ELSE '' END || CASE doc_id % 9 WHEN 0 THEN '' ELSE text END AS resume,
  CASE doc_id % 3 WHEN 0 THEN 'Go, the; c++ ;go|  Rust ' WHEN 1 THEN '' ELSE 'SQL' || chr(10) || 'sql' END AS skills_text,
  CASE doc_id % 10 WHEN 0 THEN ' Lead Cook, Chef' WHEN 1 THEN ' ' WHEN 2 THEN 'QA person' ELSE '' END AS position, CASE doc_id % 11 WHEN 0 THEN 9 ELSE 0 END AS years,
  CASE doc_id % 2 WHEN 0 THEN ' Oslo ' ELSE '' END AS place, doc_id % 4 = 0 AS remote, 'A, B ;' || chr(10) || CASE doc_id % 2 WHEN 0 THEN 'C' ELSE ';' END AS wanted_companies, doc_id % 5 AS least_pay
FROM documents
"""
#: Saved profiles as JSON, one in nine broken.
SAVED = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{"NAME":"x",' ELSE '{"NAME":"Jane Roe","SUMMARY_TEMPLATE":"' || CASE doc_id % 4 WHEN 0 THEN 'Over 6 years with {stack}' ELSE 'Knows {stack}' END || '","DEFAULT_STACK":["Go","SQL"],"SKILLS":' || CASE doc_id % 5 WHEN 0 THEN 'null'
  ELSE '{"Web":["Node.js (Express, Nest)"," Go"],"Data":["SQL (all)","go","","(x)"]}' END || ',"EXPERIENCE":[{"title":"Backend Developer","company":"Acme","dates":"' || CASE doc_id % 6 WHEN 0 THEN 'March 2019 - now' WHEN 1 THEN '2019 - 2020' WHEN 2 THEN 'Foo 2011' WHEN 3 THEN 'Dec 2023' WHEN 4 THEN 'sept  2015 to x' ELSE '' END
  || '","bullets":["did x"]},{"title":"' || CASE doc_id % 3 WHEN 0 THEN 'Backend Developer' WHEN 1 THEN '' ELSE 'Data Analyst' END || '","dates":"Jan 202' || cast(doc_id % 4 AS string) || '"}]}' END AS payload
FROM documents
"""
#: Resumes whose parts are there or not, by several remainders.
RESUMES = """
SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN 'short' ELSE CASE doc_id % 2 WHEN 0 THEN 'Backend Developer in Python, Java and SQL. ' ELSE 'developer ' END || CASE doc_id % 3 WHEN 0 THEN 'Experience 2019 2023 ' WHEN 1 THEN 'Education: 2020 ' ELSE '' END
  || CASE doc_id % 5 WHEN 0 THEN 'developed designed built led managed ' WHEN 1 THEN 'created ' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN 'Projects - certifications; (030) 123-4567 ' WHEN 1 THEN '+49123456789 in Mumbai ' ELSE 'docker go go go ' END
  || CASE doc_id % 11 WHEN 0 THEN 'github ' ELSE '' END || CASE doc_id % 6 WHEN 0 THEN substring(text, 1, 60) ELSE replace(substring(text, 1, 700), ',', '') END || CASE doc_id % 4 WHEN 0 THEN ' skills: go' WHEN 1 THEN ' Skills ' || substring(text, 1, 60) WHEN 2 THEN ' Skills ' || substring(text, 1, 90) ELSE '' END END AS resume
FROM documents
"""
PLAIN = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Go; go;SQL' WHEN 1 THEN '' ELSE 'Java' END AS primary_skills, CASE doc_id % 2 WHEN 0 THEN 'Rust;GO' ELSE '' END AS user_added_skills, CASE doc_id % 4 WHEN 0 THEN '' ELSE 'Dev;dev;QA' END AS target_titles,
  CASE doc_id % 5 WHEN 0 THEN '7' WHEN 1 THEN 'x' ELSE '3' END AS experience_years, 'any' AS remote_preference, CASE doc_id % 2 WHEN 0 THEN 'Oslo' ELSE '' END AS location FROM documents
"""
EDITS = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' Cook, ,cook ' WHEN 1 THEN '' END AS titles, CASE doc_id % 5 WHEN 0 THEN 'C,, D' END AS skills, CASE doc_id % 3 WHEN 0 THEN ' ,' END AS added, CASE doc_id % 4 WHEN 0 THEN ' 12y' WHEN 1 THEN 'none' END AS years,
  CASE doc_id % 6 WHEN 0 THEN 'remote' END AS remote FROM documents WHERE doc_id % 10 < 8
"""
LISTS = ("job_titles", "primary_skills", "secondary_skills", "user_added_skills", "all_searchable_skills", "certifications", "companies_worked_at", "domains", "preferred_companies", "search_queries")
SINGLE = ("name", "email", "phone", "education", "current_title", "experience_years", "experience_level", "max_experience_to_search", "location", "remote_preference", "min_salary")


def _shown(rows):
    return rows.select("doc_id", *[F.array_join(c, "|").alias(c) for c in LISTS], *SINGLE)


def resume_profiles(spark, d):
    return _shown(P.from_resume(view(spark, d, CANDIDATES, "documents"), LEXICON, DEFAULT, HOME))


def saved_profiles(spark, d):
    rows = P.from_saved(view(spark, d, SAVED.replace("{", "{{").replace("}", "}}"), "documents"), LEXICON, F.lit("2024-01-30").cast("date"), DEFAULT, HOME)
    return rows.select("doc_id", F.array_join("user_added_skills", "|").alias("skills"), "position", "experience_years", "experience_level", "current_title", "resume", F.array_join("search_queries", "|").alias("queries"))


def ats_scores(spark, d):
    """The same resumes, with sections, links and years on some, as a machine reads them; one in three is generated."""
    rows = view(spark, d, RESUMES, "documents")
    rows = computed_once(rows.select("doc_id", A.ats_score(F.col("resume"), F.col("doc_id") % 3 == 0).alias("r")))
    return rows.select("doc_id", "r.score", *[F.array_join(f"r.{c}", "|").alias(c) for c in ("strengths", "gaps", "advice")])


def edited_profiles(spark, d):
    """Profiles with what was typed over some of their fields, and what follows made anew."""
    rows = view(spark, d, PLAIN, "documents").withColumns({c: F.split(c, ";") for c in ("primary_skills", "user_added_skills", "target_titles")}).withColumn("job_titles", F.col("target_titles"))
    edits = view(spark, d, EDITS, "documents")
    done = P.after_edits(P.with_edits(rows, edits, "doc_id"), DEFAULT, HOME)
    return done.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("job_titles", "all_searchable_skills", "search_queries")], "experience_years", "experience_level", "current_title", "remote_preference", "location")


def alias_map(spark, d):
    rows = view(spark, d, "SELECT p_partkey AS ord, p_brand || CASE p_size % 3 WHEN 0 THEN ' (small)' WHEN 1 THEN '(x) ' ELSE '' END AS label, p_name AS alias FROM part", "part")
    return lexicon_map(rows).select("label", F.array_join("aliases", "|").alias("aliases"))


QUERIES = {f.__name__: f for f in (resume_profiles, saved_profiles, ats_scores, edited_profiles, alias_map)}


def _roles(text: str, pairs: list[tuple[str, str]]) -> str:
    each = ", ".join(f"CASE WHEN contains(lower({text}), '{n}') THEN '{r}' END" for n, r in pairs)
    return f"list_filter(list_transform([{each}], lambda v, i: CASE WHEN list_position([{each}], v) = i THEN v END), lambda v: v IS NOT NULL)"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position(list_transform({x}, lambda u: lower(trim(u))), lower(trim(v))) = i)"


_DOMAIN = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(resume), '{n}')" for n in v) + f" THEN '{k}' END" for k, v in P.DOMAINS.items())
_DEGREE = r"(^|[^a-z0-9_])(b\.?tech|b\.?e\.?|bachelor|b\.?sc|b\.?c\.?a|m\.?tech|m\.?sc|m\.?c\.?a|master|mba|ph\.?d|b\.?com|diploma)([^a-z0-9_]|$)"
_CERT = r"(^|[^a-z0-9_])(certif|certificate|certification|certified)([^a-z0-9_]|$)"
_FIRM = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9&.''\-]+(?: [A-Z][A-Za-z0-9&.''\-]+){0,3} +(?:Inc|LLC|Ltd|Pvt\.?(?: Ltd)?|Limited|Technologies|Labs|Corp|Consulting|GmbH|Systems))(?:[^A-Za-z0-9_]|$)"
_W = "' ' || chr(9) || chr(13) || chr(10)"
_LATE = TEXT_SQL["skill_split"]
_TYPED_FIRST = "CASE doc_id % 3 WHEN 0 THEN ['Article', 'Plus'] ELSE [] END"  # what the lexicon finds in the typed skills, by place
_QUERY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _queries(title: str, titles: str, primary: str, added: str) -> str:
    joined = lambda x, n: f"coalesce(array_to_string({x}[1:{n}], ' '), '')"
    listed = f"""(CASE WHEN {title} <> '' THEN [{_QUERY.format(f"{title} || ' ' || {joined(primary, 3)}")}] ELSE [] END || list_transform({titles}[1:2], lambda t: {_QUERY.format(f"t || ' ' || {joined(primary, 2)}")})
      || CASE WHEN len({primary}) > 0 THEN [{joined(primary, 4)}] ELSE [] END || CASE WHEN len({added}) > 0 THEN [{_QUERY.format(f"{title} || ' ' || {joined(added, 3)}")}] ELSE [] END)"""
    return listed


ORACLE_SQL = {
    "resume_profiles": f"""WITH c AS ({CANDIDATES}), l AS (SELECT *, list_transform(string_split_regex(resume, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85]'), lambda x: trim(x, {_W})) AS ls, string_split_regex(resume, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85]') AS raw, position || chr(10) || resume AS whole FROM c),
      s AS (SELECT doc_id, string_split(primary_tags, '|') AS p, string_split(secondary_tags, '|') AS q FROM ({_LATE.replace("FROM documents", "FROM (SELECT doc_id, resume AS text FROM c)")})),
      o AS (SELECT doc_id, list_transform(list_sort(list_filter([{_ordered}], lambda v: v IS NOT NULL)), lambda v: v[10:]) AS o FROM (SELECT doc_id, resume AS text FROM c)),
      f AS (SELECT l.*, list_filter(o, lambda x: list_contains(p, x)) AS prim, list_filter(o, lambda x: list_contains(q, x)) AS sec, {_roles('whole', P.ROLES)} AS r1, {_roles('whole', P.LANGUAGES)} AS r2, list_filter(ls, lambda x: x <> '')[1] AS head,
        {_distinct(f"({_TYPED_FIRST} || list_transform(string_split_regex(skills_text, '[,' || chr(10) || ';|]+'), lambda x: trim(x)))")} AS added, list_filter(list_transform(raw, lambda x: trim(regexp_extract(x, '{_FIRM}', 1))), lambda x: length(x) > 3) AS firms FROM l JOIN s USING (doc_id) JOIN o USING (doc_id)),
      g AS (SELECT *, CASE WHEN len(r1) > 0 THEN r1 ELSE r2 END AS titles, CASE WHEN years <> 0 THEN years ELSE coalesce(try_cast(regexp_extract(resume, '(?i)([0-9]{{1,2}})\\s*\\+?\\s*years?([^a-z0-9_]|$)', 1) AS INTEGER), 0) END AS yrs FROM f),
      h AS (SELECT *, CASE WHEN trim(position) <> '' THEN trim(split_part(position, ',', 1)) ELSE coalesce(titles[1], '') END AS title, {_distinct('(prim || added)')} AS search FROM g),
      k AS (SELECT *, {_queries('title', 'titles', 'prim', 'added')} AS qs FROM h)
      SELECT doc_id, coalesce(array_to_string(titles, '|'), '') AS job_titles, coalesce(array_to_string(prim, '|'), '') AS primary_skills, coalesce(array_to_string(sec, '|'), '') AS secondary_skills, coalesce(array_to_string(added, '|'), '') AS user_added_skills,
        coalesce(array_to_string(search, '|'), '') AS all_searchable_skills, coalesce(array_to_string(list_filter(ls, lambda x: regexp_matches(lower(x), '{_CERT}') AND length(x) <= 120)[1:6], '|'), '') AS certifications,
        coalesce(array_to_string({_distinct('firms')}[1:6], '|'), '') AS companies_worked_at, coalesce(array_to_string(list_filter([{_DOMAIN}], lambda v: v IS NOT NULL), '|'), '') AS domains,
        CASE WHEN doc_id % 2 = 0 THEN 'A|B|C' ELSE 'A|B' END AS preferred_companies, array_to_string((CASE WHEN len(qs) > 0 THEN {_distinct('qs')} ELSE ['software engineer', 'backend developer'] END)[1:6], '|') AS search_queries,
        CASE WHEN NOT regexp_matches(lower(head), '@|http|[0-9]') AND len(string_split_regex(head, '\\s+')) <= 4 AND length(head) <= 40 AND NOT regexp_matches(head, '(^|\\s)[\\p{{Ll}}\\p{{Lo}}]') THEN head ELSE '' END AS name,
        regexp_extract(resume, '{EMAIL}', 0) AS email, trim(regexp_extract(resume, '(?:^|[^0-9])(\\+?[0-9][0-9\\s\\-()]{{7,}}[0-9])(?:[^0-9]|$)', 1)) AS phone, coalesce(left(list_filter(ls, lambda x: regexp_matches(lower(x), '{_DEGREE}'))[1], 160), '') AS education, title AS current_title, yrs AS experience_years,
        CASE WHEN yrs <= 2 THEN 'JUNIOR' WHEN yrs <= 5 THEN 'MID' WHEN yrs <= 8 THEN 'SENIOR' ELSE 'LEAD' END AS experience_level, yrs + 1 AS max_experience_to_search, CASE WHEN doc_id % 2 = 0 THEN 'Oslo' ELSE '{HOME}' END AS location,
        CASE WHEN remote THEN 'remote' ELSE 'any' END AS remote_preference, doc_id % 5 AS min_salary FROM k""",
    "saved_profiles": f"""WITH s AS ({SAVED}), j AS (SELECT doc_id, json_valid(payload) AS ok, doc_id % 5 > 0 AS listed, CASE doc_id % 6 WHEN 0 THEN DATE '2019-03-01' WHEN 3 THEN DATE '2023-12-01' WHEN 4 THEN DATE '2015-09-01' END AS d1, make_date(2020 + doc_id % 4, 1, 1) AS d2, payload FROM s),
      y AS (SELECT *, CASE WHEN NOT ok THEN 2 WHEN doc_id % 4 = 0 THEN 6 ELSE greatest(1, date_diff('day', least(coalesce(d1, d2), d2), DATE '2024-01-30') // 365) END AS yrs,
        CASE WHEN NOT ok THEN [] WHEN doc_id % 3 = 2 THEN ['Backend Developer', 'Data Analyst'] ELSE ['Backend Developer'] END AS ts, CASE WHEN ok AND listed THEN ['Node.js', 'Go', 'SQL'] ELSE [] END AS sk FROM j),
      r AS (SELECT *, CASE WHEN ok THEN 'Jane Roe' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'Over 6 years with Go, SQL' ELSE 'Knows Go, SQL' END || chr(10) || json_extract_string(payload, '$.EXPERIENCE[0].dates') || ' — Backend Developer at Acme' || chr(10) || 'did x' || chr(10)
        || json_extract_string(payload, '$.EXPERIENCE[1].dates') || ' — ' || json_extract_string(payload, '$.EXPERIENCE[1].title') || ' at ' ELSE chr(10) END AS resume FROM y)
      SELECT doc_id, coalesce(array_to_string(sk, '|'), '') AS skills, coalesce(array_to_string(ts, ', '), '') AS position, CAST(yrs AS INTEGER) AS experience_years, CASE WHEN yrs <= 2 THEN 'JUNIOR' WHEN yrs <= 5 THEN 'MID' WHEN yrs <= 8 THEN 'SENIOR' ELSE 'LEAD' END AS experience_level,
        coalesce(ts[1], '') AS current_title, resume, CASE WHEN len(ts) = 0 THEN 'software engineer|backend developer' ELSE array_to_string(ts, '|') || CASE WHEN len(sk) > 0 THEN '|Backend Developer Node.js Go SQL' ELSE '' END END AS queries FROM r""",
}


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words)


def _times(words: list[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)


_SECTION_POINTS = " + ".join(f"CASE WHEN contains(low, '{k}') THEN {v} ELSE 0 END" for k, v in A.SECTIONS.items())
_PICK = lambda *rows: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in rows) + "], lambda v: v IS NOT NULL)[1:5], '|')"

ORACLE_SQL["ats_scores"] = f"""WITH c AS ({RESUMES}), l AS (SELECT *, lower(resume) AS low, doc_id % 3 = 0 AS made FROM c),
  p AS (SELECT *, {_hits(list(A.HARD_SKILLS))} AS found, {_points('resume')} AS pts, {_hits(A.TITLES)} AS titles, {_hits(list(A.SECTIONS))} AS secs, {_SECTION_POINTS} AS each_sec, len(regexp_extract_all(low, '20[0-9][0-9]')) AS yrs, {_times(A.VERBS)} AS verbs,
    CASE WHEN contains(low, 'skills') THEN length(substr(low, strpos(low, 'skills'))) ELSE 0 END AS sec, contains(resume, ',') OR contains(resume, '•') AS commas, contains(resume, '-') AS dash, regexp_matches(resume, '{EMAIL}') AS mail,
    regexp_matches(resume, '{A.NUMBER}') AS tel, ({_hits(A.PLACES)}) > 0 AS place, contains(low, 'linkedin') OR contains(low, 'github') AS links FROM l),
  t AS (SELECT *, least(35, pts) + CASE WHEN made THEN least(10, found) ELSE 0 END + CASE WHEN titles >= 2 THEN 15 WHEN titles = 1 THEN 8 ELSE 0 END + least(20, each_sec - CASE WHEN secs >= 3 THEN 0 WHEN secs = 2 THEN 5 ELSE 10 END)
    + CASE WHEN yrs >= 2 THEN 8 ELSE 0 END + CASE WHEN verbs >= 5 THEN 7 ELSE 0 END + least(20, CASE WHEN sec > 80 THEN 12 WHEN sec > 50 THEN 8 ELSE 0 END + CASE WHEN commas THEN 8 WHEN dash THEN 5 ELSE 0 END)
    + CASE WHEN mail THEN 3 ELSE 0 END + CASE WHEN tel THEN 2 ELSE 0 END + CASE WHEN place THEN 3 ELSE 0 END + CASE WHEN links THEN 2 ELSE 0 END AS s FROM p)
  SELECT doc_id, CAST(CASE WHEN length(trim(resume)) < 100 THEN 0 WHEN made THEN least(100, greatest(s + 10, 85)) ELSE least(100, s) END AS INTEGER) AS score,
    CASE WHEN length(trim(resume)) < 100 THEN '' ELSE {_PICK(("found > 0", "'hard skills: ' || found"), ("titles >= 2", "'clear title'"), ("secs >= 3", "'sections: ' || secs"), ("yrs >= 2", "'dates'"), ("verbs >= 5", "'action verbs'"), ("sec > 80", "'long skills section'"), ("sec BETWEEN 51 AND 80", "'skills section'"), ("commas", "'skills as a list'"))} END AS strengths,
    CASE WHEN length(trim(resume)) < 100 THEN 'too short' ELSE {_PICK(("found = 0", "'no hard skills'"), ("titles = 0", "'no technical title'"), ("secs = 2", "'sections missing'"), ("secs < 2", "'no structure'"), ("yrs < 2", "'no dates'"), ("verbs < 5", "'action verbs: ' || verbs"), ("NOT commas AND NOT dash", "'no list of skills'"), ("NOT mail", "'no e-mail address'"), ("NOT tel", "'no telephone number'"), ("NOT place", "'no place'"), ("NOT links", "'no profile links'"))} END AS gaps,
    CASE WHEN length(trim(resume)) < 100 THEN 'send a whole resume' ELSE {_PICK(("titles = 0", "'name the title'"), ("yrs < 2", "'date each role'"), ("verbs < 5", "'use action verbs'"), ("(NOT commas AND NOT dash) OR NOT place", "'use one column and a plain format'"), ("secs < 2", "'use standard sections'"), ("NOT mail OR NOT tel", "'put contacts on top'"), ("length(resume) < 500", "'write more'"), ("s < 50", "'rebuild around hard skills'"), ("s BETWEEN 50 AND 69", "'add hard skills'"), ("s BETWEEN 70 AND 84", "'match more keywords'"))} END AS advice FROM t"""
_OVER = lambda c, typed, kept: f"CASE WHEN {c} IS NOT NULL THEN list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '') ELSE {kept} END"
ORACLE_SQL["edited_profiles"] = f"""WITH p AS ({PLAIN}), e AS ({EDITS}), j AS (SELECT p.*, titles, skills, added, years, remote FROM p LEFT JOIN e USING (doc_id)),
  o AS (SELECT *, {_OVER('titles', 0, "string_split(target_titles, ';')")} AS t0, {_OVER('skills', 0, "string_split(primary_skills, ';')")} AS s0, {_OVER('added', 0, "string_split(user_added_skills, ';')")} AS a0,
    CASE WHEN years IS NOT NULL THEN coalesce(try_cast(regexp_extract(years, '^\\s*([0-9]+)', 1) AS INTEGER), 0) ELSE coalesce(try_cast(experience_years AS INTEGER), 0) END AS yrs FROM j),
  c AS (SELECT *, list_transform({_distinct('t0')}, lambda x: trim(x)) AS ts, list_transform({_distinct('s0')}, lambda x: trim(x)) AS ps, list_transform({_distinct('a0')}, lambda x: trim(x)) AS us FROM o),
  k AS (SELECT *, coalesce(ts[1], '') AS title, {_distinct('(ps || us)')} AS search FROM c), q AS (SELECT *, {_queries('title', 'ts', 'ps', 'us')} AS qs FROM k)
  SELECT doc_id, coalesce(array_to_string(ts, '|'), '') AS job_titles, coalesce(array_to_string(search, '|'), '') AS all_searchable_skills, array_to_string((CASE WHEN len(qs) > 0 THEN {_distinct('qs')} ELSE ['software engineer', 'backend developer'] END)[1:6], '|') AS search_queries,
    CAST(yrs AS INTEGER) AS experience_years, CASE WHEN yrs <= 2 THEN 'JUNIOR' WHEN yrs <= 5 THEN 'MID' WHEN yrs <= 8 THEN 'SENIOR' ELSE 'LEAD' END AS experience_level, title AS current_title, coalesce(remote, 'any') AS remote_preference, CASE WHEN doc_id % 2 = 0 THEN 'Oslo' ELSE '{HOME}' END AS location FROM q"""
ORACLE_SQL["alias_map"] = "SELECT p_brand AS label, string_agg(p_name, '|' ORDER BY p_partkey) AS aliases FROM part GROUP BY 1"
