"""Deduplication, ranking, diversification. Order always ends in ``ord``, the arrival ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.plan import computed_once


def first_wins(df: DataFrame, key: str, drop_blank: bool = False) -> DataFrame:
    """The first row of each key. The winner's ordinal is a partial minimum, so a hot key is not gathered in one task."""
    rows = df.where(F.coalesce(F.col(key), F.lit("")) != "") if drop_blank else df
    rest = [c for c in rows.columns if c != "ord"]
    best = rows.groupBy(F.coalesce(F.col(key), F.lit("")).alias("__key")).agg(F.min("ord").alias("ord"), F.min_by(F.struct(*rest), "ord").alias("row"))
    return best.select(*["ord" if c == "ord" else f"row.{c}" for c in df.columns])


def top(df: DataFrame, k: int) -> DataFrame:
    """Score down, then days up, then arrival; a top-k that never sorts all rows in one task."""
    return df.orderBy(F.desc("score"), F.asc("days"), F.asc("ord")).limit(k)


def diversify(df: DataFrame, k: int) -> DataFrame:
    """Round-robin over sites among equal scores, of the top ``4 k``; adds ``place`` from 1."""
    short = top(df, 4 * k)
    order = [F.desc("score"), F.asc("days"), F.asc("ord")]
    in_site = Window.partitionBy("score", "site").orderBy(*order[1:])
    rows = short.withColumn("turn", F.row_number().over(in_site)).withColumn("lead", F.first(F.struct("days", "ord")).over(in_site))
    placed = rows.orderBy(F.desc("score"), "turn", "lead").limit(k)
    return placed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "turn", "lead"))).drop("turn", "lead")


def relax(df: DataFrame, strict: Column, relaxed: Column, at_least: int) -> DataFrame:
    """Rows that pass ``strict``, or ``relaxed`` where fewer than ``at_least`` do; adds ``was_relaxed``. One plan, one count."""
    n = df.where(strict).agg((F.count(F.lit(1)) < at_least).alias("was_relaxed"))
    return df.crossJoin(F.broadcast(n)).where(strict | (F.col("was_relaxed") & relaxed))  # one row


def near_first(df: DataFrame, place: str) -> DataFrame:
    """Rows at a place (by location or title) first, then remote ones, the rest dropped; adds ``tier``."""
    needle = F.lit(place.strip().lower())
    hit = F.contains(F.lower(F.coalesce("location", F.lit(""))), needle) | F.contains(F.lower(F.coalesce("title", F.lit(""))), needle)
    tier = F.when(hit | F.lit(not place.strip()), 0).when(F.lower(F.col("is_remote").cast("string")).isin("true", "1"), 1)
    return df.withColumn("tier", tier).where(F.col("tier").isNotNull())


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of the ranked rows, from 1."""
    return df.orderBy(F.desc("score"), "days", "ord").offset((number - 1) * size).limit(size)


def generic_top(scored: DataFrame, guided: bool, k: int) -> DataFrame:
    """The ``k`` best of generic scores with a url, one for each url.

    Guided by wanted labels, two matches are asked for (or a base of 60), and one where that leaves fewer than 5 rows; else
    a score of 10.
    """
    rows = scored.where(F.coalesce("job_url", F.lit("")) != "")
    if guided:
        enough = lambda n: (F.size("matched") >= n) | (F.col("base") >= 60)
        rows = relax(rows, enough(2), enough(1), 5).drop("was_relaxed")
    else:
        rows = rows.where("score >= 10")
    return top(first_wins(rows, "job_url"), k)


def rerank(df: DataFrame, k: int) -> DataFrame:
    """By the delta of an analysis down, then the newest; the earlier rank (score, then arrival) only breaks ties."""
    return df.orderBy(F.desc("delta"), F.asc("days"), F.desc("score"), F.asc("ord")).limit(k)


def strict_stats(df: DataFrame) -> DataFrame:
    """One row: all postings, those kept (no ``reason``), and the distinct urls of those turned down."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_distinct(F.when(F.col("reason").isNotNull(), F.col("job_url"))).alias("rejected"))


def delta_counts(df: DataFrame) -> DataFrame:
    """One row: how many analyses raise a posting and how many lower it."""
    return df.agg(F.count_if(F.col("delta") > 0).alias("boosted"), F.count_if(F.col("delta") < 0).alias("penalised"))


#: Rejected rows that a run reports (part of the feature).
REPORTED = 40


def turned_down(ratio: float, least: int) -> Column:
    """Why a scored posting is not kept, by the first gate that fails: skills, then ``reason``, then the score; null where it is."""
    part, whole = F.bround(F.col("skill_ratio") * 100).cast("int").cast("string"), str(round(ratio * 100))
    low = F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" of {least}"))
    return F.when(F.col("skill_ratio") < ratio, F.concat(F.lit("skills "), part, F.lit(f"% of {whole}%"))).when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("score") < least, low)


def run(scored: DataFrame, k: int, strict: tuple[float, int] = (0.6, 50), relaxed: tuple[float, int] = (0.5, 0), at_least: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, rejected, summary) of a matching run over scored postings (with title, company and site).

    Postings without a url are left out. The gates are ratio of skills and score; where the strict ones keep fewer urls than
    ``at_least`` (or ``k``, if that is less) the relaxed ones decide. jobs: ``k`` of the ``4 k`` best, diversified by site, with
    ``place``. rejected: the first rows that are not kept, with the reason, in arrival order. summary: one row with the counts,
    whether it was relaxed, and the ratio. Both gates are columns of one plan, and the decision is one count.
    """
    rows = scored.select("ord", "title", "company", "site", "job_url", "score", "days", "skill_ratio", "reason")
    rows = computed_once(rows.withColumns({"strict_reason": turned_down(*strict), "relaxed_reason": turned_down(*relaxed)}))
    named = rows.where(F.coalesce("job_url", F.lit("")) != "")
    few = named.agg((F.count_distinct(F.when(F.col("strict_reason").isNull(), F.col("job_url"))) < min(at_least, k)).alias("relaxed"))
    judged = named.crossJoin(F.broadcast(few)).withColumn("why", F.when(F.col("relaxed"), F.col("relaxed_reason")).otherwise(F.col("strict_reason")))  # one row
    jobs = diversify(first_wins(judged.where("why is null").drop("strict_reason", "relaxed_reason", "relaxed", "why", "reason", "skill_ratio"), "job_url"), k)
    rejected = judged.where("why is not null").select("ord", "title", "company", "site", F.col("why").alias("reason")).orderBy("ord").limit(REPORTED)
    kept = F.least(F.lit(k), F.count_distinct(F.when(F.col("why").isNull(), F.col("job_url"))))
    counts = judged.agg(kept.alias("kept"), F.count_if(F.col("why").isNotNull()).alias("rejected_count"), F.coalesce(F.max("relaxed"), F.lit(False)).alias("relaxed"))
    ratio = F.when(F.col("relaxed"), relaxed[0]).otherwise(strict[0])
    summary = scored.agg(F.count(F.lit(1)).alias("fetched")).crossJoin(F.broadcast(counts)).withColumn("min_ratio", ratio)  # one row each
    return jobs, rejected, summary
