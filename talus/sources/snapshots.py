"""Feeds as landed JSON snapshots, and cards in landed HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.plan import computed_once
from talus.functions.references import unescaped
from talus.operators.feed import COLUMNS
from talus.sources.payloads import NOWHERE, POSTING, as_text, field, item_ord

#: Cards that are read of a list (fixed value).
CARDS = 25


def feeds(snapshots: DataFrame) -> DataFrame:
    """(feed, rank, fetched_at, n, the twelve columns of a feed) from snapshots (feed, rank, payload).

    A payload is an envelope ``{fetched_at, count, jobs}`` or a bare list. Of each feed the readable snapshot of least rank
    counts, say the live one before the last good one before a bundled one; broken JSON and nulls are passed over, and a feed
    without a readable snapshot has no rows, nor has one whose payload is a number or a text. Fields of jobs are texts, empty where they are null or missing; items that are
    no objects are left out. Equal ranks: the payload that sorts last. One plan; no snapshot but the chosen one is unpacked.
    """
    parsed = snapshots.select("feed", "rank", "payload", F.try_parse_json("payload").isNotNull().alias("ok")).where("ok")
    best = parsed.groupBy("feed").agg(F.max_by("payload", F.struct(-F.col("rank"), "payload")).alias("payload"), F.min("rank").alias("rank"))
    v = computed_once(best.select("feed", "rank", F.try_parse_json("payload").alias("v")))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.jobs", "array<variant>"))
    rows = v.select("feed", "rank", as_text(field(F.col("v"), "fetched_at")).alias("fetched_at"), F.posexplode(listed).alias("n", "j"))
    rows = rows.where(F.schema_of_variant("j").startswith("OBJECT"))
    return rows.select("feed", "rank", "fetched_at", "n", *[F.coalesce(as_text(field(F.col("j"), c)), F.lit("")).alias(c) for c in COLUMNS])


def snapshot_files(spark, paths: list[str], feed: str = "feed") -> DataFrame:
    """Snapshots from files of one JSON text each; those that are not there are left out, their order is their rank."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = spark.createDataFrame([], "feed string, rank int, payload string")
    for rank, path in enumerate(paths):
        p = path_of(path)
        if p.getFileSystem(conf).exists(p):
            out = out.unionByName(spark.read.text(path, wholetext=True).select(F.lit(feed).alias("feed"), F.lit(rank).alias("rank"), F.col("value").alias("payload")))
    return out


def _element(block: Column, name: str) -> Column:
    """What the first element with a class holds, as text: each piece between tags trimmed and joined. Null without one."""
    pattern = rf"""(?is)<(\w+)(?=[\s>])[^>]*?\sclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>(.*?)</\1\s*>"""
    inner = F.regexp_extract(block, pattern, 2)
    pieces = F.transform(F.split(inner, "<[^>]*>"), lambda x: F.trim(unescaped(x), F.lit(" \t\r\n\xa0")))
    return F.when(block.rlike(pattern), F.array_join(pieces, ""))


def cards(payloads: DataFrame, location: str = "", most: int = CARDS) -> DataFrame:
    """Postings of the first ``most`` list items of HTML payloads (ord, payload) that have a title and a link."""
    blocks = F.regexp_extract_all("payload", F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>"), F.lit(1))
    rows = payloads.select("ord", F.posexplode(F.slice(blocks, 1, most)).alias("n", "block"))
    b = F.col("block")
    own = F.regexp_extract(b, r"""(?is)<a(?=\s)(?=[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?base-card__full-link(?:\s[^"']*)?["'])[^>]*?\shref\s*=\s*["']([^"']*)["']""", 1)
    link = F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract(b, r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1))
    found = {"title": _element(b, "base-search-card__title"), "company": _element(b, "base-search-card__subtitle"), "place": _element(b, "job-search-card__location")}
    r = rows.select(item_ord(), *[F.coalesce(v, F.lit("")).alias(k) for k, v in found.items()], F.substring_index(unescaped(link), "?", 1).alias("job_url"), b.rlike(r"(?is)<a\s[^>]*?href\s*=").alias("linked"))
    r = computed_once(r).where("title <> '' and linked")
    place = F.coalesce(F.nullif("place", F.lit("")), F.lit(location or NOWHERE))
    columns = {
        "location": place, "site": F.lit("LinkedIn (public)"), "date_posted": F.lit(""), "is_remote": F.contains(F.lower(F.concat_ws(" ", "title", "place")), F.lit("remote")), "description": F.col("title"),
    }
    return r.select("ord", *[columns.get(c, F.col(c) if c in ("title", "company", "job_url") else None).alias(c) for c in POSTING[1:]])
