"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; sorted by that key, runs of rows become blocks, and a
block knows its annulus: the least and largest distance, and its largest norm. A query starts with the block that holds it,
which gives a k-th best score, and then only visits blocks whose annulus may hold a better one. Annuli are tested on four
numbers a query and three a block; vectors move afterwards, to the pairs that are left. By the triangle inequality a
member at distance r from pivot p is at least | d(q, p) - r | away from the query, so q.x <= (|q|^2 + |x|^2 - gap^2) / 2, and
q.x <= q.p + |q| r. Products are taken in float64 below 2^53, in int64 up to 2^62, and beyond as Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import map_batches, materialise, table

#: Vectors from which pivots are fitted, at most, and pivots.
SAMPLE = 4096
PIVOTS = 32
#: Vectors of a block, and queries that travel together, at most.
BLOCK = 1024
PACK = 256
SCALE = 1024
#: The largest score, and what stands for none.
LONG, NO = (1 << 63) - 1, -(1 << 63)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as float64 bytes; rows with null, non-finite or overflowing ones left out."""
    c = F.col("v")
    ok = F.col("vec_id").isNotNull() & c.isNotNull()
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    rows = rows.where(ok & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"vec_id": b.column(0), "v": [np.floor(scale * np.array(x, float)).astype("<f8").tobytes() for x in b.column(1).to_pylist()]}

    return map_batches(rows, run, "vec_id long, v binary")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of each query with each row as int64, whatever their size; beyond a long they are the nearest end of it."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    columns = [[int(c) for c in r] for r in x]
    return np.array([[min(max(sum(a * b for a, b in zip(r, c, strict=True)), -LONG), LONG) for c in columns] for r in ([int(c) for c in v] for v in q)], np.int64).reshape(len(q), len(x))


def others(q: np.ndarray, qid: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The products with rows of other ids; ``NO`` for rows of a query's own id."""
    s = products(q, x)
    s[qid[:, None] == ids[None, :]] = NO
    return s


def fit_pivots(rows: list[bytes], pivots: int) -> np.ndarray:
    """A few rounds of k-means over a bounded sample, started from its first distinct rows."""
    x = np.unique(np.array([np.frombuffer(r, "<f8") for r in rows]), axis=0)
    rng = np.random.default_rng(11)
    p = x[rng.permutation(len(x))[:pivots]]
    for _ in range(6):
        near = ((p * p).sum(1) - 2 * x @ p.T).argmin(axis=1)
        p = np.array([x[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
    return p


def search(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best inner products of each query with every other row, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``. A vector that is shorter than the longest counts as followed by
    zeros, an empty one as zeros. Scores beyond a long are the nearest end of it. Repeated ids are rows of their own, but a query never finds a row of its own id. Fewer
    candidates than ``k`` give fewer rows. Pivots come from at most about ``SAMPLE`` hashed rows; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, scale)
    width, total = rows.agg(F.max(F.octet_length("v")), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, zeros = max(8, width), F.lit(bytes(8))
    missing = ((F.lit(width) - F.octet_length("v")) / 8).cast("int")
    rows = rows.withColumn("v", F.when(missing > 0, F.concat("v", F.unhex(F.repeat(F.hex(zeros), missing)))).otherwise(F.col("v")))
    share = min(1_000_000, math.ceil(SAMPLE / total * 1_000_000))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("v").limit(2 * SAMPLE).collect() or rows.select("v").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(fit_pivots([r[0] for r in sample], pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        p = shared.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(b.num_rows, -1)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))
            near = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield {"vec_id": b.column(0), "v": b.column(1), "pivot": near.astype(np.int32), "r": d[np.arange(len(x)), near]}

    keyed = map_batches(rows, place, "vec_id long, v binary, pivot int, r double")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK)))
    keyed = keyed.repartitionByRange(parts, "pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made = TaskContext.get().partitionId() << 32
        ids, vs, rs, pivot = [], [], [], None

        def block() -> dict:
            nonlocal made
            made += 1
            x = np.frombuffer(b"".join(vs), "<f8").reshape(len(vs), -1)
            return {
                "block": [made], "pivot": [pivot], "low": [rs[0]], "high": [rs[-1]], "norm": [float(np.sqrt((x * x).sum(1).max()))],
                "ids": [np.array(ids, "<i8").tobytes()], "vs": [b"".join(vs)],
            }

        for b in batches:
            for i, v, p, r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if vs and (p != pivot or len(vs) == BLOCK):
                    yield block()
                    ids, vs, rs = [], [], []
                pivot = p
                ids.append(i)
                vs.append(v)
                rs.append(r)
        if vs:
            yield block()

    shape = "block long, pivot int, low double, high double, norm double, ids binary, vs binary"
    blocks = materialise(map_batches(keyed, make_blocks, shape), "pivot-index")

    def best_of(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        """(query, id, score) of the ``k`` best of a block that reach the floor."""
        s = others(q, qid, ids, x)
        out_q, out_i, out_s = [], [], []
        for row, f, query in zip(s, floor, qid, strict=True):
            at = np.flatnonzero((row >= f) & (row > NO))
            if len(at) > k:
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
            out_q += [int(query)] * len(at)
            out_i += ids[at].tolist()
            out_s += row[at].tolist()
        return out_q, out_i, out_s

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Packs of a block's own queries, with the k-th best score each finds there."""
        for b in batches:
            for block, pivot, ids, vs in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                ids = np.frombuffer(ids, "<i8")
                x = np.frombuffer(vs, "<f8").reshape(len(ids), -1)
                own = np.flatnonzero(ids % every == 0)
                for start in range(0, len(own), PACK):
                    at = own[start : start + PACK]
                    s = others(x[at], ids[at], ids, x)
                    floor = np.sort(s, axis=1)[:, -k] if len(ids) > k else np.full(len(at), NO)
                    yield {"pack": [block << 3 | start // PACK], "qids": [ids[at].tobytes()], "qs": [x[at].tobytes()], "floors": [floor.astype("<i8").tobytes()]}

    packs = materialise(map_batches(blocks.select("block", "pivot", "ids", "vs"), at_home, "pack long, qids binary, qs binary, floors binary"), "query-packs")
    annuli = blocks.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"))
    rings = spark.sparkContext.broadcast([tuple(r) for r in annuli.collect()])  # one for each pivot

    def may_hold(floor: np.ndarray, d: np.ndarray, qp: np.ndarray, qq: np.ndarray, low: float, high: float, norm: float) -> np.ndarray:
        """Which queries an annulus may serve, from their distance to its pivot, product with it, and own squared norm."""
        gap = np.maximum(np.maximum(low - d, d - high), 0)
        top = np.minimum((qq + norm * norm - gap * gap) / 2, qp + np.sqrt(qq) * high)
        slack = 1e-3 + 1e-9 * (np.abs(top) + qq + norm * norm)
        return ~(np.maximum(top + slack, float(NO)) < floor)  # also where a bound is no number

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A pack's numbers go to each pivot whose whole annulus may serve one of its queries; its vectors stay."""
        for b in batches:
            for pack, qids, qs, floors in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                floor = np.frombuffer(floors, "<i8")
                floor = np.where(floor == NO, -np.inf, floor.astype(float))
                q = np.frombuffer(qs, "<f8").reshape(len(qids) // 8, -1)
                qq = (q * q).sum(axis=1)
                for pivot, low, high, norm in rings.value:
                    p = shared.value[pivot]
                    facts = np.array([floor, np.sqrt(((q - p) ** 2).sum(axis=1)), q @ p, qq])
                    at = np.flatnonzero(may_hold(*facts, low, high, norm))
                    if len(at):
                        yield {"pivot": [pivot], "pack": [pack], "at": [at.astype("<i4").tobytes()], "facts": [facts[:, at].astype("<f8").tobytes()]}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The pairs of block and pack whose annulus may serve a query, and which queries."""
        for b in batches:
            out: dict[str, list] = {"block": [], "pack": [], "at": []}
            for block, low, high, norm, pack, at, facts in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                at = np.frombuffer(at, "<i4")
                ok = may_hold(*np.frombuffer(facts, "<f8").reshape(4, -1), low, high, norm)
                if ok.any():
                    out["block"].append(block)
                    out["pack"].append(pack)
                    out["at"].append(at[ok].tobytes())
            yield out

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The vectors of a pair's queries."""
        for b in batches:
            for block, at, qids, qs, floors in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                at, ids = np.frombuffer(at, "<i4"), np.frombuffer(qids, "<i8")
                q = np.frombuffer(qs, "<f8").reshape(len(ids), -1)
                yield {"block": [block], "qids": [ids[at].tobytes()], "qs": [q[at].tobytes()], "floors": [np.frombuffer(floors, "<i8")[at].tobytes()]}

    routed = map_batches(packs.select("pack", "qids", "qs", "floors"), route, "pivot int, pack long, at binary, facts binary")
    places = blocks.select("block", "pivot", "low", "high", "norm").join(routed, "pivot")
    met = map_batches(places.select("block", "low", "high", "norm", "pack", "at", "facts"), meet, "block long, pack long, at binary")
    wanted = met.join(packs, "pack").select("block", "at", "qids", "qs", "floors")
    wanted = map_batches(wanted, picked, "block long, qids binary, qs binary, floors binary")
    visits = blocks.select("block", "ids", "vs").join(wanted, "block").select("ids", "vs", "qids", "qs", "floors")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for row in range(whole.num_rows):
                ids, vs, qids, qs, floors = (whole.column(c)[row].as_py() for c in range(5))
                qid, ids = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                q, x = np.frombuffer(qs, "<f8").reshape(len(qid), -1), np.frombuffer(vs, "<f8").reshape(len(ids), -1)
                found = best_of(q, qid, np.frombuffer(floors, "<i8"), ids, x)
                yield {"query_id": found[0], "vec_id": found[1], "score": found[2]}

    hits = map_batches(visits, visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
