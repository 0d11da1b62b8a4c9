"""Exact Jaccard join of word-shingle sets in a metric space: pivots, Voronoi cells, windows, recursion.

Equal sets are joined first, through their digests. Then sets that cannot link are put aside: two sets at a similarity of
3/4 share 3/4 of either, so a set has a link only where others hold that much of it (``able_nodes`` proves it on the first
third of each set, ``ordered_sets`` on all of it). What is left is joined in regions (``Join.level``):

* Sets meet where they share one of the first shingles in one order (rarest first; so many that linked sets must meet).
  Each meeting names as pivot the set that is met most often.
* A set's *cell* is that of its nearest pivot, by exact Jaccard distance; it is replicated into the cell of every other pivot
  that its meetings name. So two linked sets are together in the cell of either or in one where both are replicas. In a cell,
  members within 1/4 of the pivot are one group by their links to it, and replicas of one other cell are compared there.
* Of any other pair, the overlaps with the pivot bound what the two can share inside it (the triangle inequality in numbers
  of shingles). Where that may be enough, the pair is in a window and is compared (``window_pairs``). Where it is not, the
  two must also meet outside the pivot, so the cell is a region that is joined in the same way, on what its members have
  outside all pivots so far. That shrinks each time, so this ends. Up to ``SMALL`` that meet there are compared in pairs.

Nothing is dropped or capped, and no step depends on the size of a region. Pairs of one group are not listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import Workspace, map_batches, table
from talus.llm.components import components
from talus.llm.shingles import SHINGLE, shingle_sets

#: Ids that are broadcast, at most (16 bytes each); a longer list is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A shingle is heavy if it makes up more than one in so many of all rows; so there are fewer heavy ones than this.
HEAVY = 10_000
#: In a cell, so few sets that meet are compared in pairs; more of them name a pivot.
SMALL = 16


def least_overlap(a: Column, b: Column) -> Column:
    """Intersections from here on make a link: 100 i >= 75 (a + b - i)."""
    return F.ceil((a + b) * 3 / F.lit(7)).cast("long")


def three_quarters(n: str) -> Column:
    """What a link of a set of ``n`` shingles shares at least: 3/4 of n, rounded up."""
    return F.expr(f"({n} * 3 + 3) div 4")


def head_meets(n: int) -> int:
    """Linked sets of n shingles or more meet in so many shingles of their heads."""
    return max(1, -(-n // 12))


def head_length(n: int) -> int:
    """A link may leave a quarter of a set out; so many shingles more, in one fixed order, hold ``head_meets`` shared ones."""
    return min(n, n - (3 * n + 3) // 4 + head_meets(n))


def mark_of(s: np.ndarray) -> int | None:
    """64 bits of a set's digest; null for an empty one. Sets of one mark are one set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None


def set_heads(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, mark, head): a set's size, its mark, its least third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                b = whole.slice(at, 256)
                sets = shingle_sets(b.column(1).to_pylist(), size)
                yield {
                    "doc_id": b.column(0),
                    "n": [len(s) for s in sets],
                    "mark": [mark_of(s) for s in sets],
                    "head": [s[: head_length(len(s))].view(np.int64) for s in sets],
                }

    return map_batches(docs, run, "doc_id long, n long, mark long, head array<bigint>")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(mark, n, items): the sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 128):
                sets = shingle_sets(whole.slice(at, 128).column(1).to_pylist(), size)
                yield {"mark": [mark_of(s) for s in sets], "n": [len(s) for s in sets], "items": [s.view(np.int64) for s in sets]}

    return map_batches(docs, run, "mark long, n long, items array<bigint>")


def small_semi(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is in ``ids``, a written table: by broadcast up to ``BROADCAST_IDS`` ids, else by a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, col, "left_semi")


def with_counts(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``rows`` (h, ...) whose shingle is in ``counts`` (h, c; each at least 2), with c.

    Heavy shingles, of which there are fewer than ``HEAVY``, are joined by broadcast, so no key of the shuffle has more than
    one in ``HEAVY`` of the rows.
    """
    limit = total // HEAVY
    marked = rows.join(F.broadcast(counts.where(F.col("c") > limit)), "h", "left")
    rest = marked.where("c is null").drop("c").join(counts.where(F.col("c") <= limit).hint("merge"), "h")
    return marked.where("c is not null").unionByName(rest)


def able_ids(work: Workspace, heads: DataFrame) -> DataFrame:
    """Ids of the sets of which so much of the head is in other heads as any link of theirs needs.

    A link of a set of n shingles is to one of 3/4 n or more, so their heads share ``head_meets`` of 3/4 n at least.
    """
    total = heads.agg(F.coalesce(F.sum(F.size("head")), F.lit(0))).first()[0]
    rows = heads.select(F.explode("head").alias("h"), "doc_id")
    counts = work.write(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "head-counts")
    met = with_counts(rows, counts, total).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    need = F.greatest(F.lit(1), F.ceil(three_quarters("n") / F.lit(12)))
    able = met.join(heads.select("doc_id", "n"), "doc_id").where(F.col("k") >= need).select("doc_id").distinct()
    able = work.write(able, "able")
    work.drop("head-counts")
    return able


def ordered_sets(work: Workspace, sets: DataFrame) -> DataFrame:
    """(node, n, items): of sets of which 3/4 or more is in other sets, the shared shingles, rarest first.

    Shingles of one set alone are left out; in the order they stand before all others.
    """
    rows = sets.select(F.explode("items").alias("h"), "node")
    counts = work.write(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "set-counts")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = with_counts(rows, counts, total).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    shared = shared.join(sets.select("node", "n"), "node").where(F.size("s") >= three_quarters("n"))
    out = work.write(shared.select("node", "n", F.col("s.h").alias("items")), "ordered")
    work.drop("set-counts")
    return out


class Join:
    """The recursion over ``sets`` (node, n, items); ``run`` gives exact links (u, v) that connect all linked sets.

    A level's ``members`` are (chain, node, n, rest, held, label): ``chain`` names the region (the cell it came from),
    ``rest`` what a set has outside all pivots so far, ``held`` how much it had before any. Pairs of one label are not
    compared: they are linked through the cell's pivot, or joined in another cell.
    """

    def __init__(self, work: Workspace, sets: DataFrame):
        self.work, self.sets, self.links, self.open = work, sets, [], []

    def name(self, depth: int, what: str) -> str:
        return f"{depth}-{what}"

    def run(self) -> DataFrame:
        members = self.sets.select(
            F.lit(0).cast("long").alias("chain"), "node", "n", F.col("items").alias("rest"), F.size("items").cast("long").alias("held"),
            F.col("node").alias("label"),
        )
        depth = 0
        while members is not None:
            members = self.level(members, depth)
            depth += 1
        if self.open:
            pairs = self.work.write(reduce(DataFrame.unionByName, self.open).distinct(), "pairs")
            nodes = self.work.write(pairs.select(F.explode(F.array("x", "p")).alias("node")).distinct(), "pair-nodes")
            self.links.append(self.linked(self.measure(pairs.withColumn("chain", F.lit(0).cast("long")), nodes)))
        none = self.sets.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
        return reduce(DataFrame.unionByName, self.links, none)

    @staticmethod
    def linked(measured: DataFrame) -> DataFrame:
        return measured.where("close").select(F.col("x").alias("u"), F.col("p").alias("v"))

    def measure(self, pairs: DataFrame, nodes: DataFrame, members: DataFrame | None = None, top: bool = False) -> DataFrame:
        """(chain, x, p) with n, np, i (their overlap), close. ``nodes``: a written table of all sets that the pairs name.

        With ``members``, or at the ``top`` level, whose members are whole sets, also what x has outside p and all before.
        """
        sets = small_semi(self.sets, nodes, "node")
        sx = sets.select(F.col("node").alias("x"), "n", F.col("items").alias("sx"))
        sp = sets.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("items").alias("sp"))
        both = pairs.join(sx.hint("merge"), "x")
        more = [F.array_except("sx", "sp").alias("rest"), F.size("sx").cast("long").alias("held")] if top else []
        if members is not None:
            both = both.join(members.select("chain", F.col("node").alias("x"), "rest", "held").hint("merge"), ["chain", "x"])
            more = [F.array_except("rest", "sp").alias("rest"), "held"]
        both = both.join(sp.hint("merge"), "p").withColumn("i", F.size(F.array_intersect("sx", "sp")).cast("long"))
        return both.select("chain", "x", "p", "n", "np", "i", (F.col("i") >= least_overlap(F.col("n"), F.col("np"))).alias("close"), *more)

    def level(self, members: DataFrame, depth: int) -> DataFrame | None:
        """Join one level's regions; the members of the next, or None."""
        write = lambda df, what: self.work.write(df, self.name(depth, what))
        drop = lambda *what: self.work.drop(*(self.name(depth, w) for w in what))
        # A set needs 3/4 of itself in common; ``held - size(rest)`` of that may lie inside the pivots so far.
        inside = F.col("held") - F.size("rest")
        needed = F.greatest(F.lit(1), three_quarters("n") - inside)
        alone = F.col("n") - F.col("held")
        first = F.greatest(F.lit(0), (F.col("n") - inside) - needed + 1 - alone).cast("int")
        keys = members.select("chain", "node", "n", "label", F.explode(F.slice("rest", 1, first)).alias("h"))
        regions = keys.groupBy("chain", "h").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("a"), F.max("label").alias("b"))
        regions = write(regions.where("a <> b").select("chain", "h", "k"), "regions")
        if regions.isEmpty():
            return None
        if depth:
            self.open.append(write(meeting_pairs(keys.join(regions.where(F.col("k") <= SMALL).hint("merge"), ["chain", "h"])), "pairs"))
            regions = regions.where(F.col("k") > SMALL)
            if regions.isEmpty():
                return None
        rows = write(keys.select("chain", "h", "node").join(regions.hint("merge"), ["chain", "h"]), "rows")
        met = rows.groupBy("chain", "node").agg(F.sum("k").alias("met"))
        best = F.max_by(F.col("node"), F.struct("met", -F.col("node"))).alias("p")
        named = write(rows.join(met.hint("merge"), ["chain", "node"]).groupBy("chain", "h").agg(best), "named")
        tried = rows.join(named.hint("merge"), ["chain", "h"]).where("node <> p").select("chain", F.col("node").alias("x"), "p").distinct()
        nodes = write(met.select("node").distinct(), "nodes")
        near = write(self.measure(tried, nodes, members if depth else None, top=depth == 0), "near")
        self.links.append(self.linked(near))
        pivots = named.select("chain", F.col("p").alias("x"), F.lit(True).alias("pivot")).distinct()
        likeness = F.col("i") / (F.col("n") + F.col("np") - F.col("i"))
        # A pivot's nearest pivot is itself.
        homes = near.groupBy("chain", "x").agg(F.max_by("p", F.struct(likeness, -F.col("p"))).alias("home"))
        homes = write(homes.join(pivots, ["chain", "x"], "left"), "homes")
        home = F.when(F.col("pivot").isNull(), F.col("home")).otherwise(F.col("x"))
        # Pairs of one label are not compared in this cell: those linked to its pivot, and replicas of one other cell.
        label = F.when(F.col("close"), F.col("p")).when(home == F.col("p"), F.col("x")).otherwise(home)
        inner = near.join(homes.hint("merge"), ["chain", "x"])
        inner = inner.select(F.xxhash64("chain", "p").alias("chain"), F.col("x").alias("node"), "n", "rest", "held", label.alias("label"))
        inner = write(inner, "members")
        self.open.append(write(window_pairs(inner), "windows"))
        drop("regions", "rows", "named", "nodes", "homes")
        if depth:
            self.work.drop(self.name(depth - 1, "members"))
        return inner


def sizes_allow(a: str, b: str) -> Column:
    return (F.col(a) * 4 >= F.col(b) * 3) & (F.col(b) * 4 >= F.col(a) * 3)


def meeting_pairs(rows: DataFrame) -> DataFrame:
    """(x, p): pairs of different labels that meet in one of these rows' regions, of ``SMALL`` sets at most."""
    a = rows.select("chain", "h", F.col("node").alias("x"), F.col("n").alias("na"), F.col("label").alias("la"))
    b = rows.select("chain", "h", F.col("node").alias("p"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    return a.join(b.hint("merge"), ["chain", "h"]).where((F.col("x") < F.col("p")) & (F.col("la") != F.col("lb")) & sizes_allow("na", "nb")).select("x", "p").distinct()


def window_pairs(members: DataFrame) -> DataFrame:
    """(x, p): pairs of a cell, of different labels, whose overlaps with pivots would be enough for a link.

    Without a meeting outside the pivots they share at most the lesser overlap, m, and a link needs 7 m >= 3 (nx + ny). So x
    only looks at sizes from 3/4 of its own to (7 m - 3 nx) / 3: a few windows of sizes in steps of a tenth.
    """
    step = F.lit(float(np.log(1.1)))
    window = lambda c: F.floor(F.ln(c.cast("double")) / step)
    inside = members.select("chain", "node", "n", "label", (F.col("held") - F.size("rest")).alias("i"))
    top = F.least((F.col("i") * 7 - F.col("n") * 3) / 3, F.col("n") * 4 / 3)
    x = inside.withColumn("low", F.greatest(F.col("n") * 3 / 4, F.lit(1.0))).withColumn("top", top).where("top >= low")
    x = x.select("chain", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("label").alias("la"), F.explode(F.sequence(window(F.col("low")) - 1, window(F.col("top")) + 1)).alias("w"))
    y = inside.select("chain", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("label").alias("lb"), window(F.col("n")).alias("w"))
    enough = F.least("ia", "ib") * 7 >= (F.col("na") + F.col("nb")) * 3
    p = x.join(y.hint("merge"), ["chain", "w"]).where(enough & sizes_allow("na", "nb") & (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")))
    return p.select(F.col("a").alias("x"), F.col("b").alias("p")).distinct()


def numbered(work: Workspace, held: DataFrame) -> DataFrame:
    """(mark, node, least, rows) of each set: ``least`` is its least doc_id, and its number unless that id has other texts."""
    marks = held.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    many = held.groupBy("doc_id").agg((F.min("mark") < F.max("mark")).alias("many")).where("many").withColumnRenamed("doc_id", "least")
    marks = marks.join(many.hint("merge"), "least", "left")
    return work.write(marks.select("mark", F.when(F.col("many"), F.col("mark")).otherwise(F.col("least")).alias("node"), "least", "rows"), "nodes")


def links(work: Workspace, docs: DataFrame, heads: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(u, v) links that connect all sets at a similarity of 3/4 or more, by their numbers. Not every pair; each is exact.

    ``heads``: (doc_id, n, mark, head) of one row of ``docs`` (doc_id, text) for each set.
    """
    able = able_ids(work, heads)
    texts = small_semi(docs, able, "doc_id").select("doc_id", "text")
    sets = whole_sets(texts, size).where("mark is not null").join(nodes.select("mark", "node").hint("merge"), "mark")
    sets = work.write(sets.groupBy("mark", "node", "n").agg(F.first("items").alias("items")).drop("mark"), "sets")
    ordered = ordered_sets(work, sets)
    work.drop("sets", "able")
    return Join(work, ordered).run()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id that links of 3/4 or more reach.

    Null and empty texts and those without words have no shingles and no links. Very long texts are taken whole. Repeated
    rows each give a row. Rows without an id take part in no link and have no component. Rows that share an id are one
    document: what either text links to is in one component. Other columns, whatever their names, are ignored; an empty
    table gives no rows.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    heads = work.write(set_heads(rows, size), "heads")
    sets = work.write(heads.drop("head"), "marks")
    held = sets.where("doc_id is not null and mark is not null")
    nodes = numbered(work, held)
    copied = nodes.where("rows > 1").select("mark", "least")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_IDS else copied.hint("merge")
    one = heads.where("doc_id is not null and mark is not null").join(copied, "mark", "left").where("least is null or doc_id = least").drop("least")
    found = links(work, rows, one, nodes, size)
    work.drop("heads")
    marked = held.select("doc_id", "n", "mark").join(nodes.select("mark", "node").hint("merge"), "mark")
    same_id = marked.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.collect_set("node").alias("all")).where("u <> v")
    found = found.unionByName(same_id.select("u", F.explode("all").alias("v")))
    joined = work.write(components(found), "components")
    # A component is named by its least number; its id is the least doc_id of its sets.
    least = joined.join(nodes.hint("merge"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.join(least, "component").select("node", "component_id")
    ids = nodes.join(ids.hint("merge"), "node", "left").select("mark", F.coalesce("component_id", "least").alias("component_id"))
    linked = held.select("doc_id", "n", "mark").join(ids.hint("merge"), "mark").select("doc_id", "n", "component_id")
    bare = sets.where("doc_id is null or mark is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return work.write(linked.unionByName(bare).withColumnRenamed("n", "n_shingles"), "joined")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
