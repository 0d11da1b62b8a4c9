"""Company records: normalising, classes, confidence, merging, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once, named
from talus.functions.text import company_key, contains_any, names_any
from talus.session import written

#: Words that tell kinds of business apart, tried in this order (fixed values).
BUSINESS = {
    "AI / ML": ["ai ", "ml", "machine learning", "artificial intelligence", "llm", "neural", "nlp", "deep learning"],
    "IT / Software": ["software", "it ", "development", "technology", "web", "app", "saas", "platform"],
    "Finance": ["bank", "finance", "fintech", "insurance", "trading", "investment", "crypto"],
    "Healthcare": ["health", "medical", "pharma", "hospital", "clinic", "doctor"],
    "Education": ["education", "training", "school", "course", "edtech", "university"],
    "E-commerce": ["ecommerce", "retail", "shop", "store", "marketplace"],
    "Consulting": ["consulting", "advisory"],
}
#: Words of shared offices (fixed values).
COWORKING = [
    "coworking", "co-working", "cowork", "shared office", "office space", "workspace", "work space", "business center",
    "flex office", "wework", "awfis", "smartworks", "91springboard", "innov8", "regus", "indiqube", "tablespace", "cowrks",
    "incuspaze", "worknest", "springhouse", "spring house", "devx", "collab", "myhq", "co working", "shared workspace",
    "collaborative office", "flex space", "hot desk", "hotdesk",
]
GIANTS = ["google", "microsoft", "amazon", "facebook", "apple", "ibm", "hp", "dell"]


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def size_class() -> Column:
    """enterprise, large, startup, mid or small, from company_name, website, address, building_name."""
    name, site, address, building = map(_low, ("company_name", "website", "address", "building_name"))
    new = F.contains(name, F.lit("startup"))
    return (
        F.when(names_any(name, GIANTS), "enterprise")
        .when(names_any(site, [".com.au", ".co.uk", ".gov", ".edu"]) & ~new, "large")
        .when(names_any(name, ["corp", "limited", "ltd", "inc", "plc", "sa"]) & ~names_any(name, ["startup", "incubator"]), "large")
        .when(names_any(address, ["tower", "plaza", "business park", "corporate park", "business centre", "business center"]) & ~new & ~F.contains(address, F.lit("co-working")), "large")
        .when(names_any(building, ["tower", "plaza", "park", "centre", "center", "complex", "hub"]) & ~new, "large")
        .when(names_any(name, ["startup", "incubator", "accelerator", "labs", "studio", "garage"]), "startup")
        .when(names_any(site, [".io", ".dev", ".ai", ".co"]), "startup")
        .when(names_any(address, ["incubator", "accelerator", "startup hub", "startup space"]), "startup")
        .when(names_any(name, ["enterprise", "group", "global", "international"]) | names_any(building, ["enterprise", "global"]), "mid")
        .otherwise("small")
    )


def _all_text(*columns: str) -> Column:
    return F.concat_ws(" ", *map(_low, columns))


def business_type() -> Column:
    text = _all_text("company_name", "industry", "description", "address")
    out = F.when(F.lit(False), "")
    for label, needles in BUSINESS.items():
        out = out.when(names_any(text, needles), label)
    return out.otherwise(F.coalesce(F.nullif(_low("industry"), F.lit("")), F.lit("Other")))


def is_coworking() -> Column:
    return names_any(_all_text("company_name", "industry", "description", "address", "building_name"), COWORKING)


def confidence() -> Column:
    """How complete a record is, 40 to 100."""
    return F.least(
        F.lit(100),
        F.lit(40)
        + F.when(_low("website") != "", 25).otherwise(0)
        + F.when(_low("address") != "", 10).otherwise(0)
        + F.when(F.size("phones") > 0, 10).otherwise(0)
        + F.when(~F.col("industry").isin("Unknown", ""), 10).otherwise(0)
        + F.when(F.size("source") > 1, 5).otherwise(0),
    )


def merge(df: DataFrame) -> DataFrame:
    """One row for each company: rows of one website first, then of one name and place (four decimals).

    The first row by ``ord`` stands, with the union of the sources and the first website. Both steps are sums by key, so
    chains through a merged row's other key join here.
    """
    site = F.regexp_replace(F.regexp_replace(_low("website"), r"^https?://(www\.)?", ""), r"/+$", "")
    rest = [c for c in df.columns if c not in ("ord", "source", "website")]

    def step(rows: DataFrame, key: Column) -> DataFrame:
        best = rows.withColumn("__key", F.coalesce(key, F.concat(F.lit("row "), F.col("ord").cast("string")))).groupBy("__key").agg(
            F.min("ord").alias("ord"),
            F.min_by(F.struct(*rest), "ord").alias("r"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("source")))).alias("source"),
            F.min_by("website", F.when(_low("website") != "", F.col("ord"))).alias("website"),
        )
        return best.select("ord", "r.*", "source", "website").select(*df.columns)

    by_site = step(df, F.when(site != "", F.concat(F.lit("web "), site)))
    place = F.concat_ws("|", F.trim(_low("company_name")), F.format_number("latitude", 4), F.format_number("longitude", 4))
    return step(by_site, F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.concat(F.lit("geo "), place)))


def site_key(website: Column) -> Column:
    """A website without scheme, ``www.`` and closing slashes; null where there is none."""
    low = F.lower(F.coalesce(website, F.lit("")))
    return F.when(low != "", F.regexp_replace(F.regexp_replace(low, r"^https?://(www\.)?", ""), r"/+$", ""))


def place_key(name: Column, lat: Column, lon: Column) -> Column:
    """A name and its place to four decimals; null where a coordinate is missing or 0."""
    known = (lat != 0) & (lon != 0)
    return F.when(known, F.to_json(F.array(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.bround(lat, 4).cast("string"), F.bround(lon, 4).cast("string"))))


def merge_in_order(df: DataFrame) -> DataFrame:
    """One row for each company by folding the rows in order of ``ord`` (distinct): the first record that has a row's website, else its name and place, takes the row in.

    Only records that stand register their keys: a row that was taken in does not, nor does a website that a record gained,
    so chains through taken rows stay apart (``merge`` joins them). Sources are in order of arrival; a record without a website
    gets the first one of its rows. Rows without keys stand.

    No group is gathered. Which rows stand is settled in rounds: a row that comes first among the open rows of each of its
    keys stands, and the open rows that share a key with it do not. Each round is sums by key over what is still open;
    there are as many as the longest chain of rows that hang on each other in order. A key has one record at most.
    """
    site, place = site_key(F.col("website")), place_key(F.col("company_name"), F.col("latitude"), F.col("longitude"))
    keyed = written(df.select("ord", site.alias("site"), place.alias("place")), "company-keys")
    either = F.filter(F.array(F.struct(F.lit("site").alias("kind"), F.col("site").alias("key")), F.struct(F.lit("place").alias("kind"), F.col("place").alias("key"))), lambda k: k["key"].isNotNull())
    still = written(keyed.select("ord", F.inline(either)), "company-open")
    heads = keyed.where("site is null and place is null").select("ord", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"))
    while not still.isEmpty():
        first = still.groupBy("kind", "key").agg(F.min("ord").alias("first"))
        seen = still.join(first, ["kind", "key"])
        standing = seen.groupBy("ord").agg(F.min(F.col("ord") == F.col("first")).alias("stands")).where("stands").select("ord")
        found = written(still.join(standing, "ord").select("ord", "kind", "key"), "company-heads")
        heads = heads.unionByName(found)
        taken = still.join(found.select("kind", "key"), ["kind", "key"]).select("ord").distinct()
        still = written(still.join(taken, "ord", "left_anti"), "company-open")
    heads = written(heads, "company-heads")
    of = lambda kind: heads.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("ord").alias(f"{kind}_head"))
    stands = heads.select("ord").distinct().withColumn("head", F.col("ord"))
    target = F.coalesce("head", F.when(F.col("site_head") < F.col("ord"), F.col("site_head")), F.when(F.col("place_head") < F.col("ord"), F.col("place_head")))
    owner = keyed.join(of("site"), "site", "left").join(of("place"), "place", "left").join(stands, "ord", "left").select("ord", target.alias("head"))
    rows = df.join(owner, "ord")
    sites = rows.where(F.coalesce("website", F.lit("")) != "").groupBy("head").agg(F.min_by("website", "ord").alias("website"))
    origins = rows.select("head", "ord", F.posexplode("source").alias("n", "name")).groupBy("head", "name").agg(F.min(F.struct("ord", "n")).alias("at"))
    origins = origins.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("source"))
    merged = df.drop("website", "source").join(sites.withColumnRenamed("head", "ord"), "ord", "left").join(origins.withColumnRenamed("head", "ord"), "ord", "left").join(stands.select("ord"), "ord", "left_semi")
    filled = {"website": F.coalesce("website", F.lit("")), "source": F.coalesce("source", F.array().cast("array<string>"))}
    return merged.withColumns(filled).select(*df.columns)


def name_only(harvested: DataFrame, known: DataFrame) -> DataFrame:
    """Harvested names that no known company has, one row each (first by ``ord``)."""
    keyed = harvested.withColumn("key", company_key(F.col("company_name"))).where("key <> ''")
    left = keyed.join(known.select(company_key(F.col("company_name")).alias("key")).distinct(), "key", "left_anti")
    return left.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("company_name", "ord").alias("company_name"))


def box(lat: Column, lon: Column, half_lat: Column, half_lon: Column, least: float = 0.02, most: float = 0.13) -> dict[str, Column]:
    """Bounds around a centre, with half spans widened to ``least`` and capped at ``most``."""
    a, b = (F.greatest(F.lit(least), F.least(F.lit(most), h)) for h in (half_lat, half_lon))
    return {"south": lat - a, "west": lon - b, "north": lat + a, "east": lon + b}


def geojson(df: DataFrame, *properties: str) -> DataFrame:
    """A GeoJSON feature for each row with coordinates."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.where("latitude is not null and longitude is not null").select("ord", F.to_json(feature).alias("feature"))


#: Name parts of software firms, and the pattern of names of artificial-intelligence firms (fixed values).
IT_NAMES = [
    "software", "technolog", "infotech", "info tech", "it solution", "it services", "systems", "solutions", "infosys", "cybernetics", "cyber",
    "datalab", "data systems", "cloud", "websoft", "webtech", "web solution", "app labs", "analytics", "saas", "digital", "infocom",
    "technosoft", "e-solutions", "esolutions", "technologies", "technova", "infoway", "softtech", "soft tech", "netsol", "software labs",
    "ai labs", "tech labs",
]
AI_NAMES = r"(?i)\b(a\.?i\.?|artificial intelligence|machine learning|deep learning|data science|genai|generative|neural|computer vision|nlp|mlops|llm)\b"
#: Colours of kinds on a map (fixed values).
KINDS = [(["it", "software"], "#3b82f6"), (["financ", "insur", "account"], "#22c55e"), (["retail", "shop", "local"], "#f59e0b"), (["market", "advert", "consult"], "#ec4899")]
FIRST = ["IT / Software", "AI / ML"]


def industry_for(name: Column, default: Column) -> Column:
    """A harvested name's industry: artificial intelligence before software before the default."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    return F.when(F.coalesce(name, F.lit("")).rlike(AI_NAMES), FIRST[1]).when(names_any(padded, IT_NAMES), FIRST[0]).otherwise(default)


def best_first(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` first: software firms, then by confidence, then those on the map, then those with a website."""
    known = F.coalesce(F.col("latitude") != 0, F.lit(False))
    keys = [F.col("industry").isin(FIRST), F.col("confidence"), known, F.coalesce("website", F.lit("")) != ""]
    return df.orderBy(*[F.desc(c) for c in keys], F.asc("ord")).limit(k)


def sources(df: DataFrame) -> DataFrame:
    """The distinct sources of all records."""
    return df.select(F.explode("source").alias("source")).distinct()


def map_colour(industry: Column, business: Column, technical: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(industry, F.lit("")), F.coalesce(business, F.lit(""))))
    out = F.when(F.contains(t, F.lit("cowork")), "#a78bfa").when(contains_any(t, KINDS[0][0]) | F.coalesce(technical, F.lit(False)), KINDS[0][1])
    for needles, colour in KINDS[1:]:
        out = out.when(contains_any(t, needles), colour)
    return out.otherwise("#94a3b8")


def openings_url(careers: Column, name: Column, search: str) -> Column:
    """The firm's own page of openings, else a search for its name."""
    encoded = F.url_encode(F.coalesce(name, F.lit("")))
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.coalesce(F.nullif(careers, F.lit("")), F.concat(F.lit(search), encoded))


#: Marks of web techniques in pages and their headers (fixed values).
TECHNIQUES = {
    "React": ["react", "_next/static/chunks", "data-reactroot"], "Next.js": ["/_next/", "__next", "next.js"], "Angular": ["ng-version", "angular"], "Vue": ["vue", "__vue__", "data-v-"],
    "Nuxt": ["__nuxt", "nuxt"], "Node.js": ["x-powered-by: express", "node"], "Express": ["x-powered-by: express"], "NestJS": ["nestjs"], "Laravel": ["laravel_session", "laravel"],
    "PHP": ["x-powered-by: php", ".php"], "Django": ["csrfmiddlewaretoken", "django"], "Flask": ["flask"], "FastAPI": ["fastapi", "swagger-ui"], "Spring Boot": ["jsessionid", "spring"],
    ".NET": ["asp.net", "__viewstate", "x-aspnet-version"], "Ruby on Rails": ["csrf-param", "rails"], "WordPress": ["wp-content", "wp-includes", "wordpress"], "Shopify": ["cdn.shopify.com", "shopify"],
    "WooCommerce": ["woocommerce"], "Magento": ["magento", "mage/"], "Wix": ["wix.com", "_wix"], "Webflow": ["webflow"], "Squarespace": ["squarespace"], "Cloudflare": ["cf-ray", "cloudflare"],
    "AWS": ["x-amz-", "amazonaws.com", "cloudfront"], "Google Analytics": ["gtag(", "google-analytics.com", "googletagmanager"], "HubSpot": ["hs-scripts", "hubspot"],
}


def techniques(page: Column, headers: Column, marks: dict[str, list[str]] | None = None) -> Column:
    """Names whose marks a page or its headers hold, whatever the case, sorted."""
    marks = TECHNIQUES if marks is None else marks

    def of(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(contains_any(low, marks[k]), F.lit(k)) for k in sorted(marks)], F.lit(None).cast("string")))

    return named(F.lower(F.concat_ws(" ", F.coalesce(page, F.lit("")), F.coalesce(headers, F.lit("")))), of)


def enriched(df: DataFrame) -> DataFrame:
    """Adds company_size and is_coworking_space, and puts the kind that the texts tell into business_type, over what was there."""
    return computed_once(df.withColumns({"company_size": size_class(), "is_coworking_space": is_coworking(), "business_type": business_type()}))


def viewed(df: DataFrame, firms_only: bool = True, kind: str = "", industry: str = "", with_site: bool = False, shared: bool = False, text: str = "") -> DataFrame:
    """The records that all of some conditions hold for: software firms, a kind, an industry, a website, a shared office, a text in name, industry or address."""
    out = df.where(F.col("industry").isin(FIRST)) if firms_only else df
    out = out.where(F.col("business_type") == kind) if kind else out
    out = out.where(F.col("industry") == industry) if industry else out
    out = out.where(F.coalesce("website", F.lit("")) != "") if with_site else out
    out = out.where(F.contains(_low("business_type"), F.lit("cowork"))) if shared else out
    return out.where(F.contains(_all_text("company_name", "industry", "address"), F.lit(text.lower()))) if text else out


def choices(df: DataFrame) -> DataFrame:
    """(field, value, records) of what a view may be cut to: each kind and each industry, blanks left out."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("business_type", "industry")]))
    return df.select(each).where(F.coalesce("value", F.lit("")) != "").groupBy("field", "value").agg(F.count(F.lit(1)).alias("records"))


def web_record(df: DataFrame, technical: Column, source: str) -> DataFrame:
    """Rows (ord, company_name, website, industry) as whole records of a web search: what is not known is empty, or null where it is a number."""
    empty, strings, pairs = F.lit(""), F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    texts = ("legal_name", "linkedin", "google_maps", "address", "city", "state", "pincode", "employees", "founded", "careers", "coworking_name", "building_name", "opening_hours", "osm_id")
    return df.select(
        "ord", "company_name", F.coalesce("website", empty).alias("website"), "industry", F.lit("Company / Office").alias("business_type"), technical.alias("technical_work"), (~technical).alias("non_technical_work"),
        *[empty.alias(c) for c in texts], *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")], F.lit(None).cast("boolean").alias("hiring"),
        *[strings.alias(c) for c in ("technologies", "emails", "phones", "office_images")], *[pairs.alias(c) for c in ("social_links", "ratings")], F.array(F.lit(source)).alias("source"), F.lit(0).alias("confidence"),
    )


#: Shared offices by their tag and by their name; firms in titles of results about them; offices that are searched for (fixed values).
SHARED_TAG, SHARED_NAME = r"^(coworking|shared|hotdesk)", r"(?i)(coworking|co-working|shared office|startup hub|tech park|business park)"
TENANT = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9&.\-\s]{2,40}(?:Ltd|Inc|Pvt|Corp|Tech|Systems))(?![A-Za-z0-9_])"
SPACES = 5


def shared_spaces(features: DataFrame, most: int = SPACES) -> DataFrame:
    """The first named shared offices among features (ord, tags), with trimmed names of three letters or more."""
    name = F.trim(F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")))
    office = F.coalesce(F.try_element_at("tags", F.lit("office")), F.lit(""))
    return features.withColumn("space", name).where((F.length("space") >= 3) & (office.rlike(SHARED_TAG) | F.col("space").rlike(SHARED_NAME))).orderBy("ord").limit(most)


def tenants(results: DataFrame) -> DataFrame:
    """Whole records of the firms that titles of results (ord, title) about shared offices name, the first of each name."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(TENANT), F.lit(1)))
    rows = results.select("ord", found.alias("n", "name")).select("ord", "n", F.trim("name", F.lit(" \t\n\r")).alias("company_name")).where(F.length("company_name") >= 4)
    first = rows.groupBy(company_key(F.col("company_name")).alias("key")).agg(F.min_by(F.struct("ord", "company_name"), F.struct("ord", "n")).alias("r"))
    firms = first.select("r.ord", "r.company_name", F.lit("").alias("website"), F.lit("IT / Software").alias("industry"))
    return web_record(firms, F.lit(False), "Web (Tavily)")
