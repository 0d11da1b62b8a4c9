"""The posting feed: carry-forward, top-up, joins back, cached analyses, projection and envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talus.functions.plan import computed_once, named
from talus.operators import rank
from talus.operators.scoring import days_old
from talus.session import written

#: The feed's columns (fixed format).
COLUMNS = ["date_fetched", "title", "company", "location", "site", "date_posted", "job_url", "min_amount", "max_amount", "is_remote", "company_num_employees", "search_term"]
CARRIED_SITES = r"linkedin post|via tavily"


def project(df: DataFrame, fetched: str) -> DataFrame:
    """The twelve columns as strings; nulls and missing columns are empty, booleans read True and False."""
    out = df.withColumn("date_fetched", F.lit(fetched))
    kinds = dict(out.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        value = F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return out.select(*[text(c) for c in COLUMNS])


def fresh(fetched: Column, as_of: Column, days: int) -> Column:
    """Fetched at most so many whole days ago; unreadable dates count as fresh."""
    at = F.try_to_timestamp(F.substring(F.coalesce(fetched, F.lit("")), 1, 16), F.lit("yyyy-MM-dd HH:mm"))
    return F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400) <= days, F.lit(True))


def carry_forward(today: DataFrame, before: DataFrame, as_of: Column, days: int = 3, sites: str = CARRIED_SITES) -> DataFrame:
    """Today's rows and those earlier ones, from sites that are not read each time, that are fresh and not there today."""
    kept = before.where(F.lower(F.coalesce("site", F.lit(""))).rlike(sites) & fresh(F.col("date_fetched"), as_of, days))
    return today.unionByName(kept.join(today.select("job_url").distinct(), "job_url", "left_anti"))


def top_up(today: DataFrame, before: DataFrame, floor: int = 50) -> DataFrame:
    """Adds earlier rows where today has fewer than ``floor``; the decision is one count inside the plan."""
    thin = today.agg((F.count(F.lit(1)) < floor).alias("thin"))
    more = before.join(today.select("job_url").distinct(), "job_url", "left_anti").crossJoin(F.broadcast(thin)).where("thin").drop("thin")
    return today.unionByName(more)


def last_wins(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != "ord"]
    return df.groupBy(key).agg(F.max("ord").alias("ord"), F.max_by(F.struct(*[c for c in rest if c != key]), "ord").alias("r")).select(*[c if c in ("ord", key) else f"r.{c}" for c in df.columns])


def rejoin(ranked: DataFrame, raw: DataFrame) -> DataFrame:
    """Ranked urls with the columns of their last raw row."""
    return ranked.join(last_wins(raw, "job_url"), "job_url")


def with_analyses(ranked: DataFrame, analyses: DataFrame) -> DataFrame:
    """Ranked rows with the delta of their analysis, 0 without one."""
    return ranked.join(analyses.select("job_url", "score_delta"), "job_url", "left").fillna(0, ["score_delta"])


def to_analyse(jobs: DataFrame, cache: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Jobs without a cached analysis younger than ``days``; the cache's key is the md5 of the url."""
    young = cache.where(F.unix_timestamp(as_of) - F.unix_timestamp("cached_at") < days * 86400).select("key").distinct()
    return jobs.withColumn("key", F.md5("job_url")).join(young, "key", "left_anti")


def envelope(df: DataFrame, fetched: str, order: list[Column], rows: int = 1000) -> DataFrame:
    """One row, ``payload``: the feed as JSON, ``{fetched_at, count, jobs}``. ``jobs`` are the first ``rows`` by ``order``; the count is of all."""
    n = df.agg(F.count(F.lit(1)).alias("count"))
    first = df.orderBy(*order).limit(rows)
    placed = first.select(F.struct(F.row_number().over(Window.orderBy(*order)).alias("place"), F.struct(*COLUMNS).alias("job")).alias("r"))  # ``rows`` rows
    jobs = placed.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["job"]).alias("jobs"))
    return n.crossJoin(jobs).select(F.to_json(F.struct(F.lit(fetched).alias("fetched_at"), "count", "jobs")).alias("payload"))  # one row each


def write_feed(df: DataFrame, path: str, fetched: str, order: list[Column], rows: int = 1000) -> None:
    """Overwrite the feed at ``path`` with its envelope, one JSON text."""
    envelope(df, fetched, order, rows).coalesce(1).write.mode("overwrite").text(path)


def csv_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(place columns of ``order``, line): rows as CSV, arrays joined by "; ", quoted only where a comma, quote or line end asks for it; null is empty.

    The header is ``",".join(columns)``; Spark writes the lines of each part in order.
    """
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        value = F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string")
        return named(F.coalesce(value, F.lit("")), lambda v: F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))

    return df.select(*order, F.concat_ws(",", *map(cell, columns)).alias("line"))


def upsert(analyses: DataFrame, path: str, buckets: int = 64) -> None:
    """Put analyses (job_url, cached_at and what they say) into the table at ``path``: the latest of each url stays.

    The table is cut by a hash of the key, the md5 of the url, into bucket folders; only buckets that a run touches are read
    and replaced, by dynamic partition overwrite, so a run costs what it brings. Rows merge by their times: a run again, or a
    late one with stale rows, changes nothing, whatever the order. Equal times keep the row of the greatest reason, so any
    order gives the same. New files are written aside and moved when the job commits: a run that fails leaves the table.
    """
    spark = analyses.sparkSession
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    new = analyses.withColumn("key", F.md5("job_url")).withColumn("bucket", bucket)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    old = cached(spark, path, new.schema)
    both = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)))
    rest = [c for c in new.columns if c not in ("key", "bucket")]
    facts = [c for c in rest if c not in ("job_url", "cached_at")]
    latest = both.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), F.struct("cached_at", *facts)).alias("r"))
    rows = latest.select("key", *[f"r.{c}" for c in rest], "bucket")
    rows.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def cached(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table of analyses, None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def ranked(
    scored: DataFrame, raw: DataFrame, strict: Column, relaxed: Column, delta: Column, fits: Column, as_of: Column, at_least: int = 50, most: int = 1000, analysed: int = 100, floor: int = 50
) -> DataFrame:
    """(ord, job_url, place, delta, filled): a feed from scored postings and the raw rows they came from.

    The first posting of each url that passes ``strict`` is kept, or ``relaxed`` where fewer than ``at_least`` do; the
    ``most`` best by score, age and arrival are ranked, and each stands for the last raw row of its url. The first
    ``analysed`` of them get ``delta``, a column of that row; then the order is by delta, by the age of that row, and by rank.
    A feed under ``floor`` is topped up with other raw rows that fit, the first of each url in arrival order.

    Scores are written once, narrow; only as many rows as a feed has are ever in one task.
    """
    narrow = scored.select("ord", "job_url", "score", "days", strict.alias("strict"), relaxed.alias("relaxed")).where("strict or relaxed")
    narrow = written(narrow.where(F.coalesce("job_url", F.lit("")) != ""), "feed-scores")
    kept = rank.first_wins(narrow.where("strict"), "job_url")
    if kept.limit(at_least).count() < at_least:
        kept = rank.first_wins(narrow.where("relaxed"), "job_url")
    order = [F.desc("score"), F.asc("days"), F.asc("ord")]
    best = rank.top(kept, most).select("job_url", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # ``most`` rows
    best = written(best, "feed-ranks")
    rows = last_wins(raw.join(F.broadcast(best.select("job_url")), "job_url", "left_semi"), "job_url")
    seen = rows.join(best, "job_url").select("ord", "job_url", "rank", days_old(F.col("date_posted"), as_of).alias("days"), F.when(F.col("rank") <= analysed, delta).otherwise(0).alias("delta"))
    seen = computed_once(seen)
    out = seen.select("ord", "job_url", F.row_number().over(Window.orderBy(F.desc("delta"), "days", "rank")).alias("place"), "delta", F.lit(False).alias("filled"))
    missing = floor - best.count()
    if missing <= 0:
        return out
    others = raw.where(fits & (F.coalesce("job_url", F.lit("")) != "")).groupBy("job_url").agg(F.min("ord").alias("ord"))
    others = others.join(F.broadcast(best.select("job_url")), "job_url", "left_anti").orderBy("ord").limit(missing)
    more = others.select("ord", "job_url", (F.lit(floor - missing) + F.row_number().over(Window.orderBy("ord"))).alias("place"), F.lit(0).alias("delta"), F.lit(True).alias("filled"))
    return out.unionByName(more)
