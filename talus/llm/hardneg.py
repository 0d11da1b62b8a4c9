"""Hard negatives by a vector-approximation file.

Each dimension is quantised into 16 cells; a row's approximation is its cells, two to a byte. A block of rows keeps, for each
dimension and cell, the least and the largest component that the cell holds, so an anchor's lower and upper bound of any score
in the block are sums of entries looked up in a table of 256 for each pair of dimensions. Only rows whose bounds may bring
them into what is wanted are scored exactly: first the best rows of the anchor's own label, then, for each of these positives,
the best rows of other labels inside a window of scores below the positive's.

The anchors, a stated query set, are set against all rows in blocks: packs of anchors are dealt to groups of blocks and meet
them in a join on the group. A task keeps the best rows of each anchor over the blocks it has seen (bounded, and handed on
when full), so the floors rise from block to block and few rows leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import BATCH_ROWS, map_batches, materialise, table

SCALE = 256
#: Cells of a dimension, rows that choose their borders (also at most so many bytes), rows of a block at most, anchors of a pack.
CELLS = 16
SAMPLE, SAMPLE_BYTES = 4096, 8 << 20
BLOCK, PACK = BATCH_ROWS, 128
#: Anchors whose best rows a task holds at once.
HELD = 20_000
LONG = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): scale * x of each component, whose floors numpy takes (a long may not hold them); rows that take no part left out."""
    named = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("long").alias("label"), rows[vec_col].cast("array<double>").alias("v"))
    scaled = named.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * scale) < float("inf"), x * scale)))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return scaled.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The floors of a list column as rows of ``width``; shorter lists are followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as int64, whatever their size; beyond a long they are the nearest end of it."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q)
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x], object)
    return np.array([min(max(s, -LONG), LONG) for s in whole], np.int64)


def approximate(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells packed two to a byte, dimension by row; least; largest component of each dimension and cell)."""
    width = x.shape[1]
    cells = np.zeros((width + width % 2, len(x)), np.uint8)
    low, high = np.zeros((len(cells), CELLS)), np.zeros((len(cells), CELLS))
    for d in range(width):
        cells[d] = np.searchsorted(edges[d], x[:, d], "right")
        order = np.argsort(cells[d], kind="stable")
        there, start = np.unique(cells[d][order], return_index=True)
        low[d, there] = np.minimum.reduceat(x[order, d], start)
        high[d, there] = np.maximum.reduceat(x[order, d], start)
    return cells[::2] << 4 | cells[1::2], low, high


def bounds(q: np.ndarray, packed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the score of each anchor (row of ``q``) with each approximated row."""
    q = np.pad(q, ((0, 0), (0, len(low) - q.shape[1])))
    a, b = q[:, :, None] * low, q[:, :, None] * high
    out = []
    for side in (np.minimum(a, b), np.maximum(a, b)):
        total = np.zeros((len(q), packed.shape[1]))
        for j in range(len(packed)):
            pairs = (side[:, 2 * j, :, None] + side[:, 2 * j + 1, None, :]).reshape(len(q), CELLS * CELLS)
            total += np.take(pairs, packed[j], axis=1)
        out.append(total)
    slack = np.maximum(np.abs(a), np.abs(b)).max(axis=2).sum(axis=1, keepdims=True) * 1e-12
    return out[0] - slack, out[1] + slack


class Best:
    """The best ``k`` (score, id) of each of ``n`` slots, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def floor(self, slot: int) -> float:
        """No row below this can enter."""
        return float(self.scores[slot][-1]) if len(self.scores[slot]) == self.k else -np.inf

    def add(self, slot: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[slot], ids]), np.concatenate([self.scores[slot], scores])
        at = np.lexsort((ids, -scores))[: self.k]
        self.ids[slot], self.scores[slot] = ids[at], scores[at]


def reach(lower: np.ndarray, k: int) -> float:
    """The k-th largest of lower bounds: k rows have at least this score."""
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


def blocks_of(rows: DataFrame, width: int, edges: np.ndarray, per_block: int) -> DataFrame:
    """Runs of at most ``per_block`` rows of a partition, with approximations and components. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, per_block):
                part = b.slice(at, per_block)
                x = matrix(part.column(2), width)
                packed, low, high = approximate(x, edges)
                small = np.abs(x).max(initial=0) < 2**15
                yield {
                    "block": [made], "ids": [part.column(0).to_numpy().tobytes()], "labels": [part.column(1).to_numpy().tobytes()], "cells": [packed.tobytes()],
                    "low": [low.tobytes()], "high": [high.tobytes()], "exact": [x.astype("<i2" if small else "<f8").tobytes()],
                }
                made += 1

    return map_batches(rows, run, "block long, ids binary, labels binary, cells binary, low binary, high binary, exact binary")


def packs_of(rows: DataFrame, width: int, per_pack: int) -> DataFrame:
    """Anchors in packs: ids, labels, vectors, and the positives of each where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, per_pack):
                part = b.slice(at, per_pack)
                x = matrix(part.column(2), width)
                yield {"pack": [made], "aids": [part.column(0).to_numpy().tobytes()], "alabels": [part.column(1).to_numpy().tobytes()], "q": [x.tobytes()], "wanted": pa.array([part.column(3).to_pylist()], pa.list_(pa.list_(pa.list_(pa.int64()))))}
                made += 1

    return map_batches(rows, run, "pack long, aids binary, alabels binary, q binary, wanted array<array<array<bigint>>>")


def met(blocks: DataFrame, packs: DataFrame, groups: int, visit, schema: str) -> DataFrame:
    """Every pack meets every block; ``visit(seen)`` is called on (pack, block) rows of a task and yields what it keeps.

    Packs are copied to each group, which Spark's estimates do not see, so they are never broadcast.
    """
    left = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    right = packs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = left.join(right.hint("merge"), "g").select("pack", "aids", "alabels", "q", "wanted", "ids", "labels", "cells", "low", "high", "exact")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                pack, aids, alabels, q, wanted, ids, labels, cells, low, high, exact = (b.column(c)[i].as_py() for c in range(11))
                aids, alabels, ids, labels = (np.frombuffer(x, "<i8") for x in (aids, alabels, ids, labels))
                x = np.frombuffer(exact, "<i2" if len(exact) == 2 * len(ids) * (len(q) // 8 // len(aids)) else "<f8").reshape(len(ids), -1)
                low, high = (np.frombuffer(t, "<f8").reshape(-1, CELLS) for t in (low, high))
                packed = np.frombuffer(cells, np.uint8).reshape(len(low) // 2, len(ids))
                yield pack, aids, alabels, np.frombuffer(q, "<f8").reshape(len(aids), -1), wanted, ids, labels, packed, low, high, x

    return map_batches(pairs, lambda batches: visit(seen(batches)), schema)


def own_label(k: int, held: int):
    """The best ``k`` other rows of each anchor's label."""

    def flush(kept: dict) -> dict:
        out = [(int(a), int(i), int(s)) for aids, best in kept.values() for a, ids, scores in zip(aids, best.ids, best.scores, strict=True) for i, s in zip(ids, scores, strict=True)]
        return dict(zip(("anchor_id", "positive_id", "positive_score"), map(list, zip(*out, strict=True)), strict=True)) if out else {"anchor_id": [], "positive_id": [], "positive_score": []}

    def visit(seen) -> Iterator[dict]:
        kept: dict = {}
        for pack, aids, alabels, q, _, ids, labels, packed, low, high, x in seen:
            best = kept.setdefault(pack, (aids, Best(len(aids), k)))[1]
            common = np.flatnonzero(np.isin(labels, alabels))
            if len(common):
                lower, upper = bounds(q, packed[:, common], low, high)
                for a in range(len(aids)):
                    may = (labels[common] == alabels[a]) & (ids[common] != aids[a])
                    may &= upper[a] >= max(best.floor(a), reach(lower[a][may], k))
                    at = common[may]
                    if len(at):
                        best.add(a, ids[at], products(x[at].astype(float), q[a]))
            if sum(len(v[0]) for v in kept.values()) > held:
                yield flush(kept)
                kept = {}
        yield flush(kept)

    return visit


def in_windows(k: int, low_share: int, high_share: int, held: int):
    """For each positive of each anchor, the best ``k`` rows of other labels inside its window of scores."""
    names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")

    def flush(kept: dict) -> dict:
        out = []
        for slots, best in kept.values():
            for (a, place, p, ps), ids, scores in zip(slots, best.ids, best.scores, strict=True):
                out += [(a, place, p, ps, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

    def visit(seen) -> Iterator[dict]:
        kept: dict = {}
        for pack, aids, alabels, q, wanted, ids, labels, packed, low, high, x in seen:
            if pack not in kept:
                slots = [(int(a), place, p, ps) for a, found in zip(aids, wanted, strict=True) for place, (p, ps) in enumerate(found or [])]
                kept[pack] = slots, Best(len(slots), k)
            slots, best = kept[pack]
            lower, upper = bounds(q, packed, low, high)
            slot = 0
            for a, found in enumerate(wanted):
                other, masks = labels != alabels[a], []
                for _, ps in found or []:
                    least, most = -(-low_share * ps // 100), high_share * ps // 100
                    sure = other & (lower[a] >= least) & (upper[a] <= most)
                    need = max(least, best.floor(slot + len(masks)), reach(lower[a][sure], k))
                    masks.append(other & (upper[a] >= need) & (lower[a] <= most) if least <= most else np.zeros(len(ids), bool))
                at = np.flatnonzero(np.logical_or.reduce(masks)) if masks else np.zeros(0, int)
                if len(at):
                    scores = products(x[at].astype(float), q[a])
                    for w, (_, ps) in enumerate(found):
                        fits = masks[w][at] & (scores >= -(-low_share * ps // 100)) & (scores <= high_share * ps // 100)
                        if fits.any():
                            best.add(slot + w, ids[at[fits]], scores[fits])
                slot += len(masks)
            if sum(len(v[0]) for v in kept.values()) > held:
                yield flush(kept)
                kept = {}
        yield flush(kept)

    return visit


def mine(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90, scale: int = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", block: int = BLOCK, pack: int = PACK, held: int = HELD,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for anchors whose id is divisible by ``every``.

    Scores are integer inner products of floor(scale * x), higher first, ties to smaller ids; beyond a long they count as the
    nearest end of it. Positives are the first other rows (of another id) of an anchor's label; negatives the first rows of
    other labels with low_share * positive_score <= 100 * negative_score <= high_share * positive_score, so a positive with a
    negative score has none.

    Rows with a null id, label or vector, or with a null, non-finite or (times ``scale``) overflowing component take no part.
    A shorter vector counts as followed by zeros, an empty one as zeros. Rows that repeat an id are candidates each, but one
    anchor: the one of least label, then least vector. Fewer candidates give fewer rows; an empty table none. Other columns
    are not read. Cell borders come from a bounded sample and only affect speed; every row is indexed.
    """
    spark = rows.sparkSession
    ints = integers(rows, id_col, label_col, vec_col, scale)
    anchor = F.col("vec_id") % every == 0
    width, total, anchors = ints.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if(anchor)).first()
    if not anchors:
        return spark.createDataFrame([], RESULT)
    width = max(1, width)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    share = min(1_000_000, most * 1_000_000 // total + 1)
    sample = ints.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("v").limit(most).collect() or ints.select("v").limit(most).collect()
    seen = matrix(pa.array([r[0] for r in sample], pa.list_(pa.float64())), width)
    edges = np.quantile(seen, np.arange(1, CELLS) / CELLS, axis=0).T.reshape(width, CELLS - 1)
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block)))
    blocks = materialise(blocks_of(ints, width, edges, block), "va-file")

    none = F.lit(None).cast("array<array<bigint>>")
    one = materialise(ints.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "anchors")
    dealt = lambda df: df.repartition(-(-anchors // pack), F.xxhash64("vec_id"))
    found = met(blocks, packs_of(dealt(one.withColumn("wanted", none)), width, pack), groups, own_label(positives, held), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    wanted = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.array("place", "positive_id", "positive_score"))).alias("w"))
    wanted = wanted.withColumn("wanted", F.transform("w", lambda x: F.slice(x, 2, 2))).drop("w")
    ready = materialise(one.join(wanted, "vec_id").select("vec_id", "label", "v", "wanted"), "positives")
    shape = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    hits = met(blocks, packs_of(dealt(ready), width, pack), groups, in_windows(negatives, low_share, high_share, held), shape)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``, where ids divisible by 7 have the next label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))
