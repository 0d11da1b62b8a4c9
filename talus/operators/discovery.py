"""Companies from map features, search results and their own sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once, named
from talus.functions.references import unescaped
from talus.functions.text import EMAIL, company_key, contains_any, names_any
from talus.operators.companies import COWORKING, AI_NAMES, IT_NAMES, industry_for

# Office kinds with industry and whether the work is technical.
OFFICES = {
    "it": ("IT / Software", True),
    "software": ("IT / Software", True),
    "telecommunication": ("Telecom", True),
    "engineer": ("Engineering", True),
    "research": ("Research / R&D", True),
    "consulting": ("Consulting", False),
    "advertising_agency": ("Advertising / Marketing", False),
    "marketing": ("Digital Marketing", False),
    "financial": ("Finance", False),
    "financial_advisor": ("Finance", False),
    "insurance": ("Insurance", False),
    "accountant": ("Accounting", False),
    "tax_advisor": ("Accounting / Tax", False),
    "lawyer": ("Legal", False),
    "estate_agent": ("Real Estate", False),
    "employment_agency": ("Recruitment / HR", False),
    "educational_institution": ("Education", False),
    "logistics": ("Logistics", False),
    "coworking": ("Coworking Space", False),
    "government": ("Government", False),
    "ngo": ("NGO / Non-profit", False),
    "association": ("Association", False),
    "newspaper": ("Media", False),
    "travel_agent": ("Travel", False),
    "architect": ("Architecture", False),
}
HEALTH = ["clinic", "hospital", "pharmacy", "doctors", "dentist"]
SCHOOLS = ["college", "university", "school", "training", "language_school", "driving_school", "kindergarten"]
HOTELS = ["hotel", "motel", "guest_house", "hostel", "resort", "apartment"]
GYMS = ["fitness_centre", "sports_centre", "gym"]
FOOD = ["restaurant", "cafe", "fast_food", "bar", "pub", "food_court", "ice_cream", "biergarten"]
BUSINESS_TAGS = ["office", "shop", "company", "craft", "healthcare", "building", "industrial"]
#: Named features that are no companies.
NOISE = {
    "amenity": [
        "parking", "parking_space", "parking_entrance", "bench", "waste_basket", "waste_disposal", "toilets", "bicycle_parking",
        "motorcycle_parking", "drinking_water", "fountain", "bus_station", "shelter", "clock", "post_box", "telephone", "recycling",
        "grave_yard", "place_of_worship", "fire_station", "police", "townhall", "public_building", "community_centre", "social_facility",
        "water_point", "charging_station", "taxi", "bicycle_rental", "vending_machine", "atm", "fuel", "ferry_terminal",
        "bureau_de_change", "hunting_stand",
    ],
    "leisure": [
        "park", "garden", "playground", "pitch", "common", "nature_reserve", "dog_park", "picnic_table", "track", "recreation_ground",
        "firepit", "bleachers", "slipway", "swimming_area", "fitness_station", "outdoor_seating", "bird_hide", "beach_resort",
    ],
    "tourism": ["viewpoint", "artwork", "attraction", "information", "picnic_site", "camp_site", "caravan_site", "wilderness_hut"],
}
#: Hosts that list companies and are not their own sites.
DIRECTORIES = [
    "justdial", "sulekha", "indiamart", "tradeindia", "linkedin", "indeed", "glassdoor", "ambitionbox", "naukri", "facebook", "instagram",
    "twitter", "x.com", "youtube", "wikipedia", "google.", "maps.google", "yelp", "crunchbase", "zaubacorp", "tofler", "goodfirms",
    "clutch.co", "yellowpages", "mca.gov", "quora", "reddit", "medium.com", "slideshare", "pinterest", "whatsapp", "t.me", "bing.com",
    "duckduckgo", "scribd", "apna.co", "foundit", "monster", "timesjobs", "shine.com", "hirist", "cutshort", "angel.co", "wellfound",
    "freshersworld", "placementindia", "instahyre", "6figr", "trustpilot", "mouthshut", "issuu", "coursehero", "techbehemoths", "tracxn",
    "designrush", "sortlist", "f6s", "growjo", "semrush", "similarweb", "owler", "zoominfo", "rocketreach", "yourstory", "inc42",
    "economictimes", "business-standard", "techmagnate", "manta.com",
]
SUFFIXES = (
    "Technologies|Technology|Solutions|Software|Softwares|Softech|Systems|Infotech|Infosystems|Labs|Consulting|Consultancy|Consultants|"
    r"Services|Digital|Networks|Analytics|Innovations|Infoway|Infocom|Pvt\.?[ ]?Ltd|Private[ ]Limited|LLP|Inc\.?|Corporation|Enterprises|Ventures"
)
COMPANY_NAME = rf"\b([A-Z][A-Za-z0-9&.'\-]*(?:[ ][A-Z0-9][A-Za-z0-9&.'\-]*){{0,4}}[ ](?:{SUFFIXES}))\b"
NOT_IN_NAMES = ["top ", "best ", "list ", "companies in", "list of", "the ", "these ", "our ", "software company", "it company", "click ", "read ", "view "]
NOT_FIRST = [
    "backend", "frontend", "full", "fullstack", "lead", "senior", "junior", "sr", "jr", "principal", "staff", "associate", "software",
    "web", "mobile", "cloud", "data", "devops", "qa", "ui", "ux", "the", "top", "best", "new", "our", "other", "more", "all", "various",
    "many", "several", "hire", "hiring", "job", "jobs", "apply", "view", "read", "click", "about", "contact", "home", "leading", "based",
    "global", "digital", "product", "service", "services", "custom", "enterprise", "business", "artificial", "professional", "corporate",
    "outsourcing", "management", "information", "technology", "technologies", "solution", "solutions", "consulting", "systems",
    "development", "trusted", "reliable",
]
HEADING_TITLE = (
    r"(?i)(^\s*\d)|(\btop\b)|(\bbest\b)|(\blist\b)|(companies\s+in)|(\bcompanies\b)|(\bguide\b)|(\bblog\b)|(how to)|(\bvs\b)|(\breview)|"
    r"(\bin\s+noida)|(\bin\s+\w+\s+sector)|(directory)|(\bhiring\b)|(\bjobs?\b)"
)
TITLE_PARTS = r"\s[|\-–—:]\s|\s::\s"
SOCIAL = {
    "linkedin": r"(?i)https?://[\w.]*linkedin\.com/[^\s\"'<>]+",
    "facebook": r"(?i)https?://[\w.]*facebook\.com/[^\s\"'<>]+",
    "instagram": r"(?i)https?://[\w.]*instagram\.com/[^\s\"'<>]+",
    "twitter": r"(?i)https?://[\w.]*(?:twitter|x)\.com/[^\s\"'<>]+",
    "youtube": r"(?i)https?://[\w.]*youtube\.com/[^\s\"'<>]+",
    "github": r"(?i)https?://[\w.]*github\.com/[^\s\"'<>]+",
}
OPENINGS = r"(?i)(career|careers|jobs|join-us|joinus|hiring|vacanc|we-?are-?hiring)"
STAFF = r"(?i)(hr|career|jobs|recruit|talent)"
# End of fixed values.

#: Names that one text gives, and e-mail addresses of one site, at most (part of the feature).
NAMES, ADDRESSES = 60, 8


def tag(tags: Column, key: str) -> Column:
    """A tag's value as it stands; empty where it is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def _first_of(tags: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys], F.lit(""))


def _titled(c: Column) -> Column:
    """Words with a capital each, also after a mark inside a word."""
    pieces = F.split(F.replace(c, F.lit("_"), F.lit(" ")), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda x: F.initcap(x)), "")


def feature_class(tags: Column) -> Column:
    """(industry, business_type, technical, non_technical) of a map feature; the first row of the table that fits decides."""
    office, shop, amenity, building, tourism, leisure = (F.lower(tag(tags, k)) for k in ("office", "shop", "amenity", "building", "tourism", "leisure"))
    name = tag(tags, "name")
    plain = (shop == "") & (amenity == "")
    known = F.create_map(*[c for k, (ind, tech) in OFFICES.items() for c in (F.lit(k), F.struct(F.lit(ind).alias("ind"), F.lit(tech).alias("tech")))])
    of_office = F.try_element_at(known, office)
    firm, local, retail = "Company / Office", "Local Business", "Local Business / Retail"
    shared = (office == "coworking") | (amenity == "coworking_space") | contains_any(F.lower(name), COWORKING)
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    no = F.lit(False)
    table = [
        (shared, F.lit("Coworking Space"), "Coworking", no),
        (of_office.isNotNull(), of_office["ind"], firm, of_office["tech"]),
        (plain & name.rlike(AI_NAMES), F.lit("AI / ML"), firm, F.lit(True)),
        (plain & contains_any(padded, IT_NAMES), F.lit("IT / Software"), firm, F.lit(True)),
        (office == "company", F.lit("Company (general)"), firm, no),
        (office != "", F.concat(F.lit("Office ("), office, F.lit(")")), firm, no),
        (shop != "", F.concat(F.lit("Retail ("), shop, F.lit(")")), retail, no),
        ((tag(tags, "healthcare") != "") | amenity.isin(HEALTH), F.lit("Healthcare"), "Healthcare", no),
        (amenity.isin(SCHOOLS), F.lit("Education"), "Education", no),
        (amenity == "bank", F.lit("Finance / Banking"), firm, no),
        (tourism.isin(HOTELS), F.lit("Hospitality / Hotel"), local, no),
        (leisure.isin(GYMS) | (amenity == "gym"), F.lit("Fitness / Leisure"), local, no),
        (amenity.isin(FOOD), F.lit("Food & Beverage"), retail, no),
        (amenity != "", _titled(amenity), local, no),
        (tourism != "", _titled(tourism), local, no),
        (leisure != "", _titled(leisure), local, no),
        (tag(tags, "craft") != "", F.concat(F.lit("Craft ("), tag(tags, "craft"), F.lit(")")), "Small Business", no),
        (building.isin("commercial", "office", "retail") | (tag(tags, "landuse") == "commercial"), F.lit("Commercial Building"), "Building", no),
        ((building == "industrial") | (tag(tags, "industrial") != ""), F.lit("Industrial"), "Building", no),
        (F.lit(True), F.lit("Business"), "Business", no),
    ]
    rows = [
        F.when(fits, F.struct(ind.alias("industry"), F.lit(kind).alias("business_type"), tech.alias("technical"), (~tech).alias("non_technical")))
        for fits, ind, kind, tech in table
    ]
    return F.coalesce(*rows)


def is_company(tags: Column) -> Column:
    """Named, and not a bench, a park or a viewpoint without a tag of a business."""
    business = F.greatest(*[tag(tags, k) != "" for k in BUSINESS_TAGS])
    noise = F.greatest(*[tag(tags, k).isin(v) for k, v in NOISE.items()])
    return (tag(tags, "name") != "") & (business | ~noise)


def from_map(features: DataFrame, source: str) -> DataFrame:
    """Company records from (ord, osm_id, tags, lat, lon, center_lat, center_lon); what is no company goes."""
    t = F.col("tags")
    lat, lon = (F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(f"center_{c}")) for c in ("lat", "lon"))
    kind = F.col("kind")
    one = lambda *keys: F.filter(F.array(_first_of(t, *keys)), lambda x: x != "")
    social = F.create_map(*[c for k in ("facebook", "instagram", "twitter", "youtube") for c in (F.lit(k), tag(t, f"contact:{k}"))])
    address = F.filter(F.array(*[tag(t, f"addr:{k}") for k in ("housenumber", "street", "suburb", "city", "state", "postcode")]), lambda x: x != "")
    on_map = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string"))
    rows = features.where(is_company(t)).withColumn("kind", feature_class(t)).withColumn("latitude", lat).withColumn("longitude", lon)
    return rows.select(
        "ord",
        tag(t, "name").alias("company_name"),
        tag(t, "official_name").alias("legal_name"),
        _first_of(t, "website", "contact:website", "url").alias("website"),
        tag(t, "contact:linkedin").alias("linkedin"),
        F.when((F.col("latitude") != 0) & (F.col("longitude") != 0), on_map).otherwise("").alias("google_maps"),
        F.array_join(address, ", ").alias("address"),
        *[tag(t, f"addr:{k}").alias(c) for k, c in (("city", "city"), ("state", "state"), ("postcode", "pincode"))],
        "latitude",
        "longitude",
        kind["industry"].alias("industry"),
        kind["business_type"].alias("business_type"),
        kind["technical"].alias("technical_work"),
        kind["non_technical"].alias("non_technical_work"),
        tag(t, "start_date").alias("founded"),
        one("contact:email", "email").alias("emails"),
        one("phone", "contact:phone").alias("phones"),
        F.map_filter(social, lambda k, v: v != "").alias("social_links"),
        F.when(kind["business_type"] == "Coworking", tag(t, "name")).otherwise("").alias("coworking_name"),
        tag(t, "addr:housename").alias("building_name"),
        tag(t, "opening_hours").alias("opening_hours"),
        F.array(F.lit(source)).alias("source"),
        "osm_id",
    )


def names_in(text: Column) -> Column:
    """Company names in running text: capital words that end in a word of firms, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMPANY_NAME), F.lit(1))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "), F.lit(" .,-")))

    def fits(x: Column) -> Column:
        """``x``: a name and its lower-case form."""
        first = F.substring_index(x["low"], " ", 1)
        return F.length(x["name"]).between(5, 60) & F.contains(x["name"], F.lit(" ")) & ~first.isin(NOT_FIRST) & ~names_any(x["low"], NOT_IN_NAMES)

    both = F.transform(clean, lambda x: F.struct(x.alias("name"), F.lower(x).alias("low")))

    def once(kept: Column) -> Column:
        named_low = F.transform(kept, lambda x: x["low"])
        return F.slice(F.transform(F.filter(kept, lambda x, i: F.array_position(named_low, x["low"]) == i + 1), lambda x: x["name"]), 1, NAMES)

    return named(F.filter(both, fits), once)


def title_name(title: Column) -> Column:
    """The first part of a page's title that looks like a company's name and not like a heading; null without one."""
    parts = F.transform(F.split(F.coalesce(title, F.lit("")), TITLE_PARTS), lambda x: F.trim(x))
    good = F.filter(parts, lambda x: (F.length(x) >= 3) & ~F.substring_index(F.lower(x), " ", 1).isin(NOT_FIRST) & ~x.rlike(HEADING_TITLE))
    return F.substring(F.get(good, F.lit(0)), 1, 80)


def is_directory(host: Column) -> Column:
    return names_any(F.lower(F.coalesce(host, F.lit(""))), DIRECTORIES)


def harvest(results: DataFrame, industry: str) -> DataFrame:
    """Companies of search results (ord, url, title, content): own sites by their title, and names in the text.

    (key, ord, company_name, website, industry): one row for each name without its legal form, the first that was met.
    Both steps are partial minima, so a host or name that most results hold is not gathered in one task.
    """
    host = F.regexp_extract(F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^https?://(www\.)?", ""), r"^[^/]*", 0)
    own = results.withColumn("host", host).where((F.col("host") != "") & ~is_directory(F.col("host")))
    own = own.groupBy("host").agg(F.min_by(F.struct("ord", "title", "url"), "ord").alias("r"))
    sites = own.select("r.ord", F.lit(-1).alias("pos"), title_name(F.col("r.title")).alias("company_name"), F.substring_index("r.url", "?", 1).alias("website"))
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    met = results.select("ord", F.posexplode(names_in(text)).alias("pos", "company_name")).withColumn("website", F.lit(""))
    rows = computed_once(sites.where("company_name is not null").unionByName(met).withColumn("key", company_key(F.col("company_name"))))
    first = rows.groupBy("key").agg(F.min_by(F.struct("ord", "company_name", "website"), F.struct("ord", "pos")).alias("r"))
    return first.select("key", "r.*", industry_for(F.col("r.company_name"), F.lit(industry)).alias("industry"))


def site_facts(html: Column, url: Column) -> dict[str, Column]:
    """What a company's page says: e-mail addresses, profiles elsewhere, the page of openings, whether it hires.

    Whole pages are read. The first link of each kind counts.
    """
    text = F.coalesce(html, F.lit(""))
    low = F.lower(text)
    emails = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))), 1, ADDRESSES)
    profiles = F.create_map(*[c for k, p in SOCIAL.items() for c in (F.lit(k), F.regexp_replace(unescaped(F.regexp_extract(text, p, 0)), r"[\".,)]+$", ""))])
    links = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: x.rlike(OPENINGS))
    link = F.get(links, F.lit(0))
    whole = F.concat(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), F.lit("/"), F.regexp_replace(link, "^/+", ""))
    careers = F.when(link.isNull(), "").when(link.startswith("http"), link).otherwise(whole)
    return {
        "emails": emails,
        "hr_emails": F.filter(emails, lambda x: x.rlike(STAFF)),
        "social_links": F.map_filter(profiles, lambda k, v: v != ""),
        "careers": careers,
        "hiring": link.isNotNull() | F.contains(low, F.lit("hiring")) | F.contains(low, F.lit("careers")),
    }


def parent_area(resolved: Column, country: str) -> Column:
    """A place's name without its first part and its country; null where nothing is left."""
    parts = F.split(F.coalesce(resolved, F.lit("")), ",")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    abroad = ~F.contains(F.lower(F.array_join(rest, ",")), F.lit(country))
    home = F.array_join(F.transform(F.filter(rest, lambda x: ~F.contains(F.lower(x), F.lit(country))), lambda x: F.trim(x)), ",")
    return F.when(F.size(parts) >= 2, F.nullif(F.trim(F.when(abroad, F.array_join(rest, ",")).otherwise(home)), F.lit("")))
