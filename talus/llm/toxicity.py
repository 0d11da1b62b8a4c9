"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the hashes of words, word stems, neighbouring pairs, and pairs with one or two words skipped between them;
each counts once for a document. Follow-the-regularised-leader keeps a learning rate for each coordinate, and its L1 term
leaves most weights at exactly zero, so the model is a short list of (index, weight), at most ``DIMENSIONS`` of them. It
learns from a bounded sample (``Bounds.documents``); with several shards they learn side by side and are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import id_bucket, map_batches, sampled_labels, table

BITS = 20
DIMENSIONS = 1 << BITS
#: Longer words also count by their first letters, so many.
STEMS = (4, 5, 6, 8)
#: Odd multipliers of the feature hashes.
MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\…«»“”‘’"
REMEMBERED = 300_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Bounds:
    documents: int = 8_000
    shards: int = 1
    passes: int = 4


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1


class Features:
    """Feature indices of texts; remembers the hashes of recent tokens."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, 1 + len(STEMS)), np.uint64)

    def row(self, token: str) -> int:
        word = token.strip(STRIP).lower()
        at = len(self.rows)
        self.rows[token] = at
        self.table[at, 0] = zlib.crc32(word.encode())
        for k, n in enumerate(STEMS):
            self.table[at, 1 + k] = zlib.crc32(f"{n} {word[:n]}".encode()) if len(word) > n else 0
        return at

    def __call__(self, text: str | None) -> np.ndarray:
        """Indices, with repeats. Index 0 is the constant feature."""
        tokens = (text or "").split()
        parts = [np.zeros(1, np.int64)]
        for start in range(0, len(tokens), REMEMBERED // 2):
            some = tokens[max(0, start - 3) : start + REMEMBERED // 2]
            if len(self.rows) + len(some) > REMEMBERED and len(self.rows) + len(set(some)) > REMEMBERED:
                self.rows.clear()
            get = self.rows.get
            hashes = self.table[[i if (i := get(t)) is not None else self.row(t) for t in some]]
            w = hashes[:, 0]
            mixed = [hashes.ravel() * np.uint64(MIX[0])]
            for gap in (1, 2, 3):
                mixed.append((w[:-gap] * np.uint64(MIX[gap]) + w[gap:]) * np.uint64(MIX[0]))
            parts.append((np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int64) | 1)
        return np.concatenate(parts)


def learn(features: list[np.ndarray], labels: np.ndarray, rule: Ftrl, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """One shard's weights as (index, weight), zeros left out."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == 0, 0.0, rule.l1)
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((rule.beta + np.sqrt(n[i])) / rule.alpha + rule.l2))

    for _ in range(passes):
        for i, y in zip(features, labels, strict=True):
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rule.alpha
            z[i] += g - step * w
            n[i] += g * g
    index = np.flatnonzero((np.abs(z) > rule.l1) | (np.arange(DIMENSIONS) == 0))
    return index, weights(index)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = Bounds(), rule: Ftrl = Ftrl()) -> dict[int, float]:  # noqa: B008
    """Weights by index. ``labels`` has (doc_id, label 0/1), bounded by the caller, so it is broadcast.

    Without a labelled document the model is empty, and every score is one half of nothing known: 0.5.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(labels), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        f = Features()
        for b in batches:
            found = [np.unique(f(t.as_py())).astype(np.int32) for t in b.column("text")]
            ids = b.column("doc_id")
            yield {"shard": [zlib.crc32(f"shard {i}".encode()) % bounds.shards for i in ids.to_pylist()], "doc_id": ids, "label": b.column("label"), "features": found}

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([zlib.crc32(f"order {i}".encode()) for i in rows["doc_id"]], kind="stable")
        rows = rows.iloc[order]
        index, weight = learn([np.asarray(f, np.int64) for f in rows["features"]], rows["label"].to_numpy(float), rule, bounds.passes)
        return pd.DataFrame({"index": index, "weight": weight})

    shards = (
        map_batches(rows.select("doc_id", "text", "label"), extract, "shard int, doc_id long, label int, features array<int>")
        .groupBy("shard")
        .applyInPandas(train, "index long, weight double")
    )
    found = shards.groupBy("index").agg((F.sum("weight") / bounds.shards).alias("weight")).where("weight <> 0").collect()
    return {r[0]: r[1] for r in found}


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, in a narrow stage; null and empty texts score by the constant alone."""
    index = np.array(sorted(weights), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index, np.array([weights[i] for i in index.tolist()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        f = Features()
        index, weight = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[index] = weight
        for b in batches:
            out = []
            for t in b.column(1):
                i = f(t.as_py())
                i = i[dense[i] != 0]
                out.append(float(1 / (1 + np.exp(-np.clip(dense[np.unique(i)].sum(), -30, 30)))))
            yield {"doc_id": b.column(0), "score": out}

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bounds = table(spark, sf_dir, "documents"), Bounds()
    labels = sampled_labels(table(spark, sf_dir, "labels"), "doc_id", "toxic", 4, 2, bounds.documents)
    return score(docs, fit(docs, labels, bounds=bounds)).select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
