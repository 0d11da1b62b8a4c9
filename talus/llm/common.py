"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch (a longer row is a batch of its own).
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is missing and the master is local (tests), a temporary folder becomes the session's own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talus-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/talus/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables that one operator writes in the shared folder. What has been superseded is deleted with ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, shared_dir(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[name])
            path.getFileSystem(conf).delete(path, True)


def id_bucket(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids go to no bucket)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string")), F.lit(mod))


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str
) -> DataFrame:
    """``mapInArrow`` over plain columns: ``fn`` gets and yields dicts of column name to a list or an Arrow array."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    # Texts may be long: small batches keep the memory of a task bounded. Spark reads both settings when a job starts, so
    # they stay set in the session.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def with_kept(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None, new: list[str]) -> tuple[DataFrame, str]:
    """(doc_id, __text, kept columns) and the schema of what is handed through a batch function besides ``__text``.

    ``keep`` may hold the text itself, which then crosses once more. A kept name that a new column has is refused.
    """
    keep = list(keep or [])
    clash = sorted({"doc_id", "__text", *new} & {c.lower() for c in keep})
    if clash:
        raise ValueError(f"kept columns have names of new ones: {', '.join(clash)}")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("__text"), *[docs[c] for c in keep if c != text_col])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["doc_id", *keep]
    return rows, ", ".join(f"`{c}` {kinds['__text' if c == text_col else c]}" for c in names)


def handed_on(b: pa.RecordBatch, text_col: str, keep: list[str] | None) -> dict:
    """The id and the kept columns of a batch of ``with_kept``."""
    return {"doc_id": b.column("doc_id")} | {c: b.column("__text" if c == text_col else c) for c in keep or []}


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, mod: int, hold: int, bound: int) -> DataFrame:
    """At most about ``bound`` labelled ids outside the held-out fold, picked by a hash of the id.

    One row per id (the largest label where copies disagree). The bound is a size limit, so the result may be
    broadcast. The picked share follows from one count; ids are hashed, so the same ids are picked on each run.
    """
    one = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (id_bucket("doc_id", mod) != hold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = one.count()
    if total > bound:
        share = int(bound / total * 1_000_000)
        one = one.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) < share)
    return one
