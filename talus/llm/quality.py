"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (a small dense layer over surface features),
gated attention gives it a weight learned from document labels alone, and the weighted mean of the encodings is scored. The
network is fitted on a bounded sample of labelled documents (``Bounds``); scoring covers every passage of every
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import handed_on, id_bucket, map_batches, sampled_labels, table, with_kept
from talus.llm.shingles import BLOCK, blocks, mix, words_of_block

PASSAGE = 64
THRESHOLD = 0.3
#: Byte classes whose share of a passage is a feature.
CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "high": range(128, 256),
    "stop": b".,;:",
    "cry": b"!?",
    "bar": b"|\\/_=~^<>[]{}",
    "sign": b"#$%&*@+",
}
FEATURES = len(CLASSES) + 7


@dataclass(frozen=True)
class Bounds:
    """What is learned from: about so many labelled documents, and so many passages of each, evenly spread over it."""

    documents: int = 4_000
    passages_each: int = 100


@dataclass(frozen=True)
class Shape:
    encoding: int = 12
    attention: int = 8
    steps: int = 160
    rate: float = 0.03
    decay: float = 1e-4


LUT = np.zeros((len(CLASSES), 256))
for _k, _c in enumerate(CLASSES.values()):
    LUT[_k, list(_c)] = 1
LENGTH = FEATURES - 1


def encoded(raw: np.ndarray, start: np.ndarray, end: np.ndarray, again: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Feature rows of the passages that begin at the words ``heads``, but for the length of the document."""
    count = np.diff(np.append(heads, len(start)))
    tail = np.append(heads[1:], len(start)) - 1
    span = np.maximum(end[tail] - start[heads], 1)
    found = []
    for row in LUT:
        c = np.concatenate([[0], np.cumsum(row[raw])])
        found.append((c[end[tail]] - c[start[heads]]) / span)
    letters = np.concatenate([[0], np.cumsum((LUT[0] + LUT[1] + LUT[3])[raw])])
    length = end - start
    for per_word in (length / 10, length <= 3, length > 12, letters[end] == letters[start], again):
        found.append(np.add.reduceat(per_word.astype(float), heads) / count)
    return np.stack([*found, count / PASSAGE, np.zeros(len(heads))], axis=1)


def three_words(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A hash of each word and the two before it in its text."""
    out = h.copy()
    out[1:] += np.where(rank[1:] >= 1, mix(h[:-1]), np.uint64(0))
    out[2:] += np.where(rank[2:] >= 2, mix(mix(h[:-2])), np.uint64(0))
    return out


def long_passages(data: bytes, step: int = BLOCK) -> np.ndarray:
    """Feature rows of one long text, read in pieces of whole passages; what was seen and counted goes on through all."""
    rows, seen, last, total, at, held = [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0, 0, b""
    while at < len(data):
        piece = held + data[at : at + step]
        at += step
        h, start, end = words_of_block(piece)
        # The last word may go on in the next piece.
        n = len(h) if at >= len(data) else max(0, len(h) - 1) // PASSAGE * PASSAGE
        held = piece[start[n] :] if n < len(h) else b""
        if not n:
            continue
        known = np.concatenate([last, h[:n]])
        key = mix(three_words(known, np.arange(len(known)) + total - len(last))[len(last) :])
        again = np.ones(n)
        again[np.unique(key, return_index=True)[1]] = 0
        again[np.isin(key, seen)] = 1
        seen, last, total = np.union1d(seen, key), known[-2:], total + n
        rows.append(encoded(np.frombuffer(piece, np.uint8), start[:n], end[:n], again, np.arange(0, n, PASSAGE)))
    out = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
    out[:, LENGTH] = np.log1p(total) / 10
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of all texts, and the text each belongs to. A text without words has one row of zeros."""
    rows, owner = [], []
    long = {i: b for i, b in enumerate((t or "").encode() for t in texts) if len(b) > BLOCK}
    for i, b in long.items():
        rows.append(long_passages(b))
        owner.append(np.full(len(rows[-1]), i))
    for first, last, data in blocks([None if i in long else t for i, t in enumerate(texts)]):
        h, start, end = words_of_block(data)
        if not len(h):
            continue
        sizes = np.array([1 if i in long else len((texts[i] or "").encode()) + 1 for i in range(first, last)])
        doc = np.searchsorted(np.cumsum(sizes), start, side="right")
        n_doc = np.bincount(doc, minlength=last - first)
        rank = np.arange(len(h)) - (np.cumsum(n_doc) - n_doc)[doc]
        heads = np.flatnonzero(rank % PASSAGE == 0)
        key = mix(mix(three_words(h, rank)) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = np.ones(len(h))
        again[np.unique(key, return_index=True)[1]] = 0
        rows.append(encoded(np.frombuffer(data, np.uint8), start, end, again, heads))
        rows[-1][:, LENGTH] = np.log1p(n_doc[doc[heads]]) / 10
        owner.append(first + doc[heads])
    owner_all = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    bare = np.setdiff1d(np.arange(len(texts)), owner_all)
    rows.append(np.zeros((len(bare), FEATURES)))
    owner_all = np.concatenate([owner_all, bare])
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(rows)[order].astype(np.float32), owner_all[order]


def softmax_in_bags(e: np.ndarray, heads: np.ndarray, bag: np.ndarray) -> np.ndarray:
    x = np.exp(e - np.maximum.reduceat(e, heads)[bag])
    return x / np.add.reduceat(x, heads)[bag]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(net: dict, x: np.ndarray, heads: np.ndarray, bag: np.ndarray) -> tuple:
    x = (x - net["mean"]) / net["scale"]
    h = np.tanh(x @ net["W"] + net["b"])
    t, s = np.tanh(h @ net["V"]), sigmoid(h @ net["U"])
    a = softmax_in_bags((t * s) @ net["w"], heads, bag)
    z = np.add.reduceat(a[:, None] * h, heads, axis=0)
    return x, h, t, s, a, z, sigmoid(z @ net["c"] + net["c0"])


def fit_network(x: np.ndarray, bag: np.ndarray, y: np.ndarray, shape: Shape) -> dict:
    """Adam on the mean cross-entropy of the bags. ``bag``: ascending bag numbers from 0, each present."""
    rng = np.random.default_rng(7)
    heads = np.flatnonzero(np.diff(bag, prepend=-1))
    net = {
        "mean": x.mean(axis=0),
        "scale": x.std(axis=0) + 1e-3,
        "W": rng.normal(0, 0.3, (x.shape[1], shape.encoding)),
        "b": np.zeros(shape.encoding),
        "V": rng.normal(0, 0.3, (shape.encoding, shape.attention)),
        "U": rng.normal(0, 0.3, (shape.encoding, shape.attention)),
        "w": rng.normal(0, 0.3, shape.attention),
        "c": rng.normal(0, 0.3, shape.encoding),
        "c0": np.zeros(1),
    }
    learned = [k for k in net if k not in ("mean", "scale")]
    first = {k: np.zeros_like(net[k]) for k in learned}
    second = {k: np.zeros_like(net[k]) for k in learned}
    for step in range(1, shape.steps + 1):
        xs, h, t, s, a, z, p = forward(net, x, heads, bag)
        d = (p - y) / len(y)
        g = {"c": z.T @ d, "c0": np.array([d.sum()])}
        dz = (d[:, None] * net["c"])[bag]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, heads)[bag])
        g["w"] = (t * s).T @ de
        dts = de[:, None] * net["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dz + dt @ net["V"].T + ds @ net["U"].T) * (1 - h * h)
        g["W"], g["b"] = xs.T @ dh, dh.sum(axis=0)
        rate = shape.rate * (1 - step / (shape.steps + 1))
        for k in learned:
            g[k] = g[k] + shape.decay * net[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            net[k] = net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = Bounds(), shape: Shape = Shape()) -> dict | None:  # noqa: B008
    """Fit on the labelled documents. ``labels`` has (doc_id, label 0/1), bounded by the caller, so it is broadcast.

    Passages are encoded where the documents are; one task then fits on the bounded sample. None without any label.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(labels), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x, owner = passages(b.column("text").to_pylist())
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))[1:]
            kept = [p[np.unique(np.linspace(0, len(p) - 1, bounds.passages_each).astype(int))] for p in np.split(x, cuts)] if b.num_rows else []
            yield {"doc_id": b.column("doc_id"), "label": b.column("label"), "x": [p.astype("<f4").tobytes() for p in kept]}

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for x in rows["x"]]
        net = fit_network(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array(rows["label"], float), shape)
        return pd.DataFrame({"name": list(net), "shape": [list(v.shape) for v in net.values()], "value": [v.ravel().tolist() for v in net.values()]})

    found = (
        map_batches(rows.select("doc_id", "text", "label"), encode, "doc_id long, label int, x binary")
        .groupBy(F.lit(1).alias("fold"))
        .applyInPandas(train, "name string, shape array<int>, value array<double>")
        .collect()
    )
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in found} or None


def score(docs: DataFrame, net: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, kept columns, score 0 to 1) of every whole text, in a narrow stage.

    A null or empty text is a bag of one passage of zeros. Without a network (no labels) every score is 0.5. Very long texts
    are read whole, in pieces that change nothing. Repeated rows each give a row. Other columns are ignored; a kept column
    (``keep``, the text among them if wished) whose name a new one has is a ValueError. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept, schema = with_kept(docs, id_col, text_col, keep, ["score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        net = shared.value
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 512):
                b = whole.slice(at, 512)
                if net is None or not b.num_rows:
                    p = [0.5] * b.num_rows
                else:
                    x, owner = passages(b.column("__text").to_pylist())
                    p = forward(net, x, np.flatnonzero(np.diff(owner, prepend=-1)), owner)[-1].tolist()
                yield handed_on(b, text_col, keep) | {"score": p}

    return map_batches(kept, run, f"{schema}, score double")


def fitted(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> dict | None:  # noqa: B008
    """Fit on labelled documents whose crc32 of the id, modulo 5, is not 0."""
    return fit(docs, sampled_labels(labels, "doc_id", "quality", 5, 0, bounds.documents), bounds=bounds)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
