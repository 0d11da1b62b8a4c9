"""A training corpus from ``documents``: quality, language, near copies, packing.

``STAGES`` lists (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands it, read again, to the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import jaccard, langid, packing, quality
from talus.llm.bpe import default_vocabulary
from talus.llm.common import id_bucket, materialise, table

#: Documents below this quality go, and those whose language is not clear to this degree.
MIN_QUALITY = 0.3
MIN_LANGUAGE = 0.3
#: Words that a worker of the packing stage remembers: executors have run other stages before it.
REMEMBERED = 150_000


def _safe(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` as (id, text, and every column but the text under a name that no operator uses), and the kept names."""
    kept = [c for c in docs.columns if c != "text"]
    named = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__body"), *[F.col(c).alias(f"__kept_{i}") for i, c in enumerate(kept)])
    return named, ["__body", *[f"__kept_{i}" for i in range(len(kept))]]


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    return rows.select(*[F.col("__body" if c == "text" else f"__kept_{kept.index(c)}").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of good quality (op 6).

    Null and empty texts are scored like others, as one empty passage. Repeated rows are decided alike, each for itself.
    Columns of any name come through; an empty table gives an empty one.
    """
    net = quality.fitted(docs, table(spark, sf_dir, "labels"))
    named, kept = _safe(docs)
    return _restored(quality.score(named, net, "__id", "__body", keep=kept).where(F.col("score") >= MIN_QUALITY), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows (op 3): those without letters or with an unclear one go.

    So null and empty texts go. Repeated rows are decided alike. Columns of any name come through; an empty table, or one
    without a language to learn from, gives an empty one.
    """
    model = langid.fit(docs.where(F.col("lang").isNotNull() & (id_bucket("doc_id", 4) != 2)))
    named, kept = _safe(docs)
    seen = langid.predict(named, model, "__id", "__body", keep=kept)
    return _restored(seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)), docs)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document (by id) of each group of near copies (op 8).

    A document without an id or without words is in no group and stays. Rows that repeat an id are one document: the one
    whose text comes first stays. Columns of any name come through; an empty table gives an empty one.
    """
    joined = jaccard.join(docs)
    dropped = materialise(joined.where("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    repeated = materialise(joined.where("doc_id is not null").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("many")).where("many").select("doc_id"), "repeated-ids")
    small = lambda ids: F.broadcast(ids) if ids.count() <= jaccard.BROADCAST_IDS else ids
    left = docs.join(small(dropped), "doc_id", "left_anti").select(*docs.columns)
    once = left.join(small(repeated), "doc_id", "left_anti").select(*docs.columns)
    again = left.join(small(repeated), "doc_id", "left_semi")
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("__row"))
    return once.unionByName(again.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens (op 7).

    Null and empty texts are their end token alone; repeated rows are documents of their own; an empty table gives no rows.
    """
    return packing.pack_documents(docs, default_vocabulary(), ranks=packing.ranks_beside(), remembered=REMEMBERED)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_copies", copies_stage), ("packing", packing_stage)]

#: The stages learn models and encode text, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
