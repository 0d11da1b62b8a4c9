"""Queries that read landed payloads of job boards. The payloads are made of documents by SQL that both engines read.

Every shape of the fields occurs: texts, numbers, lists, nulls, missing fields, and payloads that are broken.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.references import unescaped
from talus.plans.adapters import POSTINGS, postings, view
from talus.sources import payloads as P

HOURS = 240
KEYWORDS = ["Backend Developer", "tionea"]
COMPANY, SLUG = "Acme", "acme"

_TITLE = "CASE doc_id % 6 WHEN 0 THEN 'Backend Engineer' WHEN 1 THEN 'Senior Java &amp; Go' WHEN 2 THEN 'Data Analyst' WHEN 3 THEN 'Remote API Lead' WHEN 4 THEN 'Gardener' ELSE '' END"
_BODY = "translate(substring(text, 1, 2500), chr(34) || chr(92) || chr(10) || chr(13) || chr(9) || '<>&', '        ')"
_DAY = "'2024-01-' || lpad(cast(doc_id % 28 + 1 AS string), 2, '0')"
_SECONDS = "cast(1704067200 + doc_id % 28 * 86400 + 3600 AS string)"
_LINK = "'https://jobs.example.org/' || md5(text)"
_MIXED_DATE = f"""CASE doc_id % 5 WHEN 0 THEN {_SECONDS} WHEN 1 THEN '"' || {_SECONDS} || '"' WHEN 2 THEN '"' || {_DAY} || 'T10:00:00Z"' WHEN 3 THEN '"soon"' ELSE 'null' END"""
_ISO_DATE = f"""CASE doc_id % 4 WHEN 0 THEN '"' || {_DAY} || '"' WHEN 1 THEN '"' || {_DAY} || 'T08:30:00.250000+02:00"' WHEN 2 THEN '"' || {_DAY} || ' 23:59:59"' ELSE 'null' END"""
_HTML = f"""'"<p>' || {_BODY} || '</p>a<br/>b &eacute;"'"""


def _object(**fields: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


def _quoted(x: str) -> str:
    return f"""'"' || {x} || '"'"""


_PLACE = """CASE doc_id % 4 WHEN 0 THEN '"India"' WHEN 1 THEN '""' WHEN 2 THEN 'null' ELSE '"Remote, EU"' END"""
_TAGS = """CASE doc_id % 3 WHEN 0 THEN '["golang","x"]' WHEN 1 THEN '[]' ELSE 'null' END"""
_URL = f"""CASE WHEN doc_id % 9 = 0 THEN '""' ELSE {_quoted(_LINK)} END"""

#: (what stands around the item, the item) of each board.
ITEMS = {
    "remotive": ("'{\"jobs\":['", "']}'", _object(title=_quoted(_TITLE), company_name="'\"Acme\"'", candidate_required_location=_PLACE, publication_date=_ISO_DATE, url=_URL, description=_HTML)),
    "remoteok": ("'[{\"legal\":\"notice\"},'", "']'", _object(position=_quoted(_TITLE), company="'\"Acme\"'", location=_PLACE, date=_ISO_DATE, url=_URL, apply_url="'\"https://apply.example.org/\"'", tags=_TAGS, description=_HTML)),
    "jobicy": ("'{\"jobs\":['", "']}'", _object(jobTitle=_quoted(_TITLE), companyName="'\"Acme\"'", jobGeo=_PLACE, pubDate="'null'", date=_ISO_DATE, url=_URL, jobDescription="CASE doc_id % 2 WHEN 0 THEN '\"\"' ELSE " + _HTML + " END", jobExcerpt="'\"short\"'")),
    "arbeitnow": ("'{\"data\":['", "']}'", _object(title=_quoted(_TITLE), company_name="'\"Acme\"'", location=_PLACE, created_at=_MIXED_DATE, url=_URL, remote="CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END", tags=_TAGS, description=_HTML)),
    "himalayas": (
        "CASE WHEN doc_id % 13 = 0 THEN '{\"jobs\":[],\"data\":[' ELSE '{\"jobs\":[' END", "']}'",
        _object(
            title=_quoted(_TITLE), companyName="CASE doc_id % 3 WHEN 0 THEN 'null' ELSE '\"Acme\"' END", company_name="'\"Initech\"'",
            seniority="CASE doc_id % 7 WHEN 0 THEN '\"Senior\"' WHEN 1 THEN '[\"Senior\",\"Mid-level\"]' WHEN 2 THEN 'null' WHEN 3 THEN '[\"Lead\",\"Staff\"]' WHEN 4 THEN '\"\"' WHEN 5 THEN '[]' ELSE '\"Entry-level\"' END",
            pubDate=_MIXED_DATE, applicationLink="CASE doc_id % 4 WHEN 0 THEN '\"\"' WHEN 1 THEN 'null' ELSE '\"https://apply.example.org/' || md5(text) || '\"' END", guid=_URL,
            locationRestrictions="CASE doc_id % 4 WHEN 0 THEN '[\"India\",\"Nepal\"]' WHEN 1 THEN '[]' WHEN 2 THEN 'null' ELSE '\"Anywhere\"' END", description=_HTML,
        ),
    ),
    "greenhouse": ("'{\"jobs\":['", "']}'", _object(title=_quoted(_TITLE), updated_at=_ISO_DATE, absolute_url=_URL, location="CASE doc_id % 3 WHEN 0 THEN 'null' ELSE '{\"name\":' || " + _PLACE + " || '}' END")),
    "lever": ("'['", "']'", _object(text=_quoted(_TITLE), createdAt="CASE doc_id % 3 WHEN 0 THEN " + _SECONDS + " || '500' WHEN 1 THEN 'null' ELSE '\"x\"' END", hostedUrl=_URL, descriptionPlain="CASE doc_id % 5 WHEN 0 THEN 'null' ELSE " + _quoted(_BODY) + " END", categories="CASE doc_id % 7 WHEN 0 THEN 'null' ELSE '{\"team\":\"Core\",\"location\":' || " + _PLACE + " || '}' END")),
    "ashby": ("'{\"jobs\":['", "']}'", _object(title=_quoted(_TITLE), location=_PLACE, publishedAt=_ISO_DATE, descriptionPlain="CASE doc_id % 5 WHEN 0 THEN 'null' ELSE " + _quoted(_BODY) + " END", isRemote="CASE doc_id % 2 WHEN 0 THEN 'true' ELSE 'null' END", jobUrl="CASE doc_id % 3 WHEN 0 THEN " + _URL + " ELSE 'null' END", applyUrl="CASE doc_id % 4 WHEN 0 THEN '\"https://apply.example.org/\"' ELSE '\"\"' END", id="CASE doc_id % 5 WHEN 0 THEN 'null' ELSE cast(doc_id AS string) END")),
    "hackernews": ("'{\"children\":['", "']}'", "'{\"id\":' || cast(doc_id AS string) || ',\"text\":' || CASE doc_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '\"Backend | REMOTE<p>' || " + _BODY + " || '<a href=' || chr(92) || chr(34) || 'https:&#x2F;&#x2F;x.example.org' || chr(92) || chr(34) || '>\"' WHEN 2 THEN '\"" + "' || " + _BODY + " || '&#x2F;<p>more\"' ELSE '\"&amp;Backend &lt;x&gt;<p>y<p>z\"' END || '},{\"text\":\"Backend" + "' || cast(doc_id AS string) || ' link\",\"id\":7}'"),
}
_RSS = f"""'<rss><channel><title>all</title>' || '<item><title>' || CASE doc_id % 4 WHEN 0 THEN 'Acme: Backend Engineer' WHEN 1 THEN 'Backend &amp; more' WHEN 2 THEN ': Backend' ELSE 'Acme:' END || '</title><region>' || CASE doc_id % 3 WHEN 0 THEN '' ELSE 'Europe' END
 || '</region><category>' || CASE doc_id % 5 WHEN 0 THEN 'Backend' ELSE 'Design' END || '</category><pubDate>Mon, 22 Jan 2024 10:00:00 +0000</pubDate><link>' || {_LINK} || '</link><description>' || CASE doc_id % 2 WHEN 0 THEN '' ELSE '&lt;p&gt;' || {_BODY} || '&lt;/p&gt;' END || '</description></item></channel></rss>'"""


def _payload(board: str) -> str:
    """A payload for each document; one in 17 is broken."""
    whole = _RSS if board == "weworkremotely" else " || ".join((ITEMS[board][0], ITEMS[board][2], ITEMS[board][1]))
    return f"SELECT doc_id AS ord, CASE WHEN doc_id % 17 = 0 THEN substring({whole}, 1, 60) ELSE {whole} END AS payload FROM documents"


def _landed(spark, d, board):
    return view(spark, d, _payload(board).replace("{", "{{").replace("}", "}}"), "documents")  # braces are marks there


def _as_of():
    return F.lit("2024-01-30T00:00:00Z").cast("timestamp")


def _parsed(spark, d, board):
    rows = _landed(spark, d, board)
    if board in ("greenhouse", "lever"):
        return getattr(P, board)(rows, COMPANY, KEYWORDS, HOURS, _as_of())
    if board == "ashby":
        return P.ashby(rows, COMPANY, SLUG, KEYWORDS, HOURS, _as_of())
    if board in ("hackernews", "weworkremotely"):
        return getattr(P, board)(rows, KEYWORDS)
    return getattr(P, board)(rows, HOURS, _as_of())


BOARDS = ["remotive", "remoteok", "jobicy", "arbeitnow", "himalayas", "greenhouse", "lever", "ashby", "hackernews", "weworkremotely"]
QUERIES = {f"board_{b}": (lambda spark, d, b=b: _parsed(spark, d, b)) for b in BOARDS}


def fan_in(spark, d):
    """All boards together, for a junior, the first posting of each url."""
    short = [_parsed(spark, d, b).select("ord", "title", "site", "job_url") for b in BOARDS]
    return P.fan_in(short, "JUNIOR").select("rank", "ord", "title", "site", "job_url")


def term_scans(spark, d):
    """Postings as found by three terms, whose results overlap; one scan lacks columns."""
    p = postings(spark, d).select("ord", "job_url", "title", "company")
    scans = [("backend", p.where("ord % 2 = 0")), ("java remote", p.where("ord % 3 = 0").drop("company")), ("", p)]
    return P.scanned(scans).select("rank", "search_term", "ord", "job_url", "title", "company")


def decoded_references(spark, d):
    """References of all kinds in place of the blanks of every document."""
    ref = "CASE doc_id % 9 WHEN 0 THEN '&eacute;' WHEN 1 THEN '&#233;' WHEN 2 THEN '&#xE9;' WHEN 3 THEN '&copy' WHEN 4 THEN '&amp;lt;' WHEN 5 THEN '&#128;' WHEN 6 THEN '&#x1F600;' WHEN 7 THEN '&nosuch;' ELSE '&NotEqualTilde;' END"
    rows = view(spark, d, f"SELECT doc_id, replace(replace(text, '&', ''), ' ', {ref}) AS body FROM documents", "documents")
    return rows.select("doc_id", unescaped(F.col("body")).alias("body"))


QUERIES |= {f.__name__: f for f in (fan_in, term_scans, decoded_references)}


# SQL of the same rows, from JSON functions of DuckDB.


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(j->>'$.{n}', '')" for n in names) + ", '')"


def _any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def _young(x: str) -> str:
    zone = f"CASE WHEN regexp_matches({x}, 'T.*\\+02:00$') THEN 7200 ELSE 0 END"
    return f"coalesce(epoch(TIMESTAMP '2024-01-30') - epoch(try_cast(left(replace({x}, 'Z', ''), 19) AS TIMESTAMP)) + {zone} <= {HOURS} * 3600, TRUE)"


def _plain(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '<br */?>|</p>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for ref, char in (("&eacute;", "é"), ("&#x2F;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ' || chr(10))"


_LIST = {"remoteok": "v", "lever": "v", "arbeitnow": "v->'data'", "himalayas": "CASE WHEN json_array_length(v->'jobs') > 0 THEN v->'jobs' ELSE v->'data' END", "hackernews": "v->'children'"}


def _items_sql(board: str) -> str:
    return f"""WITH src AS ({_payload(board)}), ok AS (SELECT ord, CASE WHEN json_valid(payload) THEN payload::JSON END AS v FROM src), l AS (SELECT ord, {_LIST.get(board, "v->'jobs'")} AS l FROM ok),
      n AS (SELECT ord, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS n FROM l), i AS (SELECT ord * 2147483648 + n AS ord, n, json_extract(l, '$[' || n || ']') AS j FROM n)"""


def _sql(board: str, where: str, date: str, **c: str) -> str:
    c = {"company": "'Acme'", "is_remote": "TRUE", "date_posted": "left(dated, 10)"} | c
    return f"{_items_sql(board)}, a AS (SELECT *, {date} AS dated FROM i) SELECT ord, {', '.join(f'{c[k]} AS {k}' for k in P.POSTING[1:])} FROM a WHERE ({where}) AND {_young('dated')}"


_tag_text = "CASE json_type(j->'tags') WHEN 'ARRAY' THEN array_to_string(from_json(j->'tags', '[\"VARCHAR\"]'), ' ') ELSE '' END"
_levels = "CASE json_type(j->'seniority') WHEN 'VARCHAR' THEN lower(j->>'seniority') WHEN 'ARRAY' THEN lower(coalesce(array_to_string(from_json(j->'seniority', '[\"VARCHAR\"]'), ' '), '')) ELSE '' END"
_raw = _first("pubDate", "publishedDate", "date")
_stamp = "strftime(make_timestamp(CAST({0} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S')"
_numbers = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN {_stamp.format(x)} ELSE "
_fits = lambda x: _any(f"lower({x})", ["backend", "tionea"])
_or_remote = lambda x: f"coalesce(nullif({x}, ''), 'Remote')"
_or_none = lambda x: f"coalesce(nullif({x}, ''), '{P.NOWHERE}')"
_about = "left(coalesce(j->>'descriptionPlain', ''), 1500)"
_says = lambda t, p: f"contains(lower({t} || ' ' || {p}), 'remote')"
_POSITION, _NAME, _CREATED = _first("position"), _first("title"), "coalesce(j->>'$.created_at', '')"
_HEAD = r"regexp_extract(j->>'text', '(?s)^(.*?)(\n|<p>|$)', 1)"
_said = _plain("coalesce(j->>'text', '')")
_href = "replace(regexp_extract(j->>'text', 'href=\"([^\"]+)\"', 1), '&#x2F;', '/')"
_tag = lambda k: f"replace(replace(replace(regexp_extract(block, '(?s)<{k}>(.*?)</{k}>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"

ORACLE_SQL = {
    "board_remotive": _sql("remotive", "TRUE", _first("publication_date"), title=_first("title"), location=_or_remote(_first("candidate_required_location")), site="'remotive'", job_url=_first("url"), description=_plain(_first("description"))),
    "board_remoteok": _sql("remoteok", f"{_first('position')} <> '' AND {_any(f'lower({_POSITION} || chr(32) || {_tag_text})', P.DEVELOPER)}", _first("date"), title=_first("position"), location=_or_remote(_first("location")), site="'remoteok'", job_url=_first("url", "apply_url"), description=_plain(_first("description"))),
    "board_jobicy": _sql("jobicy", f"{_first('url')} <> ''", _first("pubDate", "date"), title=_first("jobTitle"), location=_or_remote(_first("jobGeo")), site="'jobicy'", job_url=_first("url"), description=_plain(_first("jobDescription", "jobExcerpt"))) + " QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY ord) = 1",
    "board_arbeitnow": _sql(
        "arbeitnow", _any(f"lower({_first('title')} || ' ' || {_tag_text})", P.DEVELOPER), f"{_numbers(_CREATED)} '' END", title=_first("title"),
        location=f"coalesce(nullif({_first('location')}, ''), CASE WHEN j->>'remote' = 'true' THEN 'Remote' ELSE '' END)", site="'arbeitnow'", is_remote="coalesce(j->>'remote' = 'true', FALSE)", job_url=_first("url"), description=_plain(_first("description")),
    ),
    "board_himalayas": _sql(
        "himalayas",
        f"{_any(f'lower({_NAME})', P.DEVELOPER)} AND NOT ({_levels} <> '' AND NOT {_any(_levels, P.OPEN_TO)} AND {_any(_levels, P.CLOSED_TO)}) AND {_first('applicationLink', 'guid', 'url')} <> ''",
        f"{_numbers(_raw)} {_raw} END", title=_first("title"), company=_first("companyName", "company_name"), site="'himalayas'", job_url=_first("applicationLink", "guid", "url"), description=_plain(_first("description", "excerpt")),
        location="CASE WHEN json_type(j->'locationRestrictions') = 'ARRAY' AND json_array_length(j->'locationRestrictions') > 0 THEN array_to_string(from_json(j->'locationRestrictions', '[\"VARCHAR\"]'), ', ') ELSE 'Remote' END",
    ),
    "board_greenhouse": _sql("greenhouse", _fits(_first("title")), _first("updated_at"), title=_first("title"), location=_or_none(_first("location.name")), site="'Acme careers (Greenhouse)'", is_remote=_says(_first("title"), _first("location.name")), job_url=_first("absolute_url"), description=f"trim({_first('title')} || ' at Acme. ' || {_first('location.name')})"),
    "board_lever": _sql(
        "lever", _fits(f"{_first('text')} || ' ' || {_about}"), "CASE WHEN regexp_matches(j->>'createdAt', '^[0-9]+$') THEN " + _stamp.format("(CAST(j->>'createdAt' AS BIGINT) // 1000)") + " ELSE '' END", title=_first("text"),
        location=f"coalesce(nullif({_first('categories.location')}, ''), nullif({_first('categories.team')}, ''), '{P.NOWHERE}')", site="'Acme careers (Lever)'", is_remote=_says(_first("text"), _first("categories.location")), job_url=_first("hostedUrl"), description=f"coalesce(nullif({_about}, ''), {_first('text')} || ' at Acme')",
    ),
    "board_ashby": _sql(
        "ashby", _fits(f"{_first('title')} || ' ' || {_about}") + f" AND ({_first('jobUrl', 'applyUrl', 'id')} <> '')", _first("publishedAt"), title=_first("title"), location=_or_none(_first("location")), site="'Acme careers (Ashby)'",
        is_remote=f"coalesce(j->>'isRemote' = 'true', FALSE) OR {_says(_first('title'), _first('location'))}", job_url=f"CASE WHEN {_first('jobUrl', 'applyUrl')} <> '' THEN {_first('jobUrl', 'applyUrl')} ELSE 'https://jobs.ashbyhq.com/acme/' || (j->>'id') END",
        description=f"coalesce(nullif({_about}, ''), {_first('title')} || ' at Acme')",
    ),
    "board_hackernews": _sql(
        "hackernews", f"n < 80 AND {_said} <> '' AND {_fits(_said)}", "''", title=f"left(coalesce(nullif({_plain(_HEAD)}, ''), {_said}), 140)", company="'(HN Who''s Hiring)'", location=f"'{P.NOWHERE}'", site="'Hacker News'",
        date_posted="''", is_remote=f"contains(lower({_said}), 'remote')", job_url=f"CASE WHEN {_href} <> '' THEN {_href} ELSE 'https://news.ycombinator.com/item?id=' || (j->>'id') END", description=f"left({_said}, 1500)",
    ),
    "board_weworkremotely": f"""WITH src AS ({_payload('weworkremotely')}), b AS (SELECT ord, unnest(regexp_extract_all(payload, '(?s)<item>(.*?)</item>', 1)) AS block FROM src),
      f AS (SELECT ord * 2147483648 AS ord, {', '.join(f'{_tag(k)} AS f_{k}' for k in ('title', 'link', 'pubDate', 'region', 'category', 'description'))} FROM b),
      g AS (SELECT *, coalesce(nullif(trim(CASE WHEN contains(f_title, ':') THEN substr(f_title, strpos(f_title, ':') + 1) ELSE f_title END), ''), f_title) AS role FROM f WHERE {_fits("f_title || ' ' || f_category")})
      SELECT ord, role AS title, coalesce(nullif(trim(split_part(f_title, ':', 1)), ''), '{P.NOWHERE}') AS company, {_or_remote('f_region')} AS location, 'WeWorkRemotely' AS site, left(f_pubDate, 16) AS date_posted, TRUE AS is_remote, f_link AS job_url,
      coalesce(nullif(left({_plain('f_description')}, 1500), ''), role) AS description FROM g""",
    "decoded_references": """SELECT doc_id, replace(replace(text, '&', ''), ' ', CASE doc_id % 9 WHEN 0 THEN 'é' WHEN 1 THEN 'é' WHEN 2 THEN 'é' WHEN 3 THEN '©' WHEN 4 THEN '&lt;' WHEN 5 THEN '€' WHEN 6 THEN '😀' WHEN 7 THEN '&nosuch;' ELSE '≂̸' END) AS body FROM documents""",
}
ORACLE_SQL["fan_in"] = (
    "SELECT rank, ord, title, site, job_url FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS rank, ord, title, site, job_url FROM ({ORACLE_SQL[f'board_{b}']})" for i, b in enumerate(BOARDS))
    + ") WHERE job_url <> '' AND NOT regexp_matches(title, '(?i)\\b(senior|sr\\.?|staff|principal|lead|director|head\\b|vp\\b|architect|manager)\\b') QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY rank, ord) = 1"
)
ORACLE_SQL["term_scans"] = f"""WITH p AS ({POSTINGS}), s AS (SELECT 0 AS rank, 'backend' AS search_term, ord, job_url, title, company FROM p WHERE ord % 2 = 0 UNION ALL SELECT 1, 'java remote', ord, job_url, title, '' FROM p WHERE ord % 3 = 0 UNION ALL SELECT 2, '', ord, job_url, title, company FROM p)
  SELECT rank, search_term, ord, job_url, title, company FROM s QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY rank, ord) = 1"""
