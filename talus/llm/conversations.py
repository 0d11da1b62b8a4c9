"""Repair of conversation structure by Dial's bucket-queue shortest paths.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Its rows are steps of a graph whose nodes are (rows
done, state of that pattern) and whose arcs are edits of small integer cost; distances to the end are found from a queue of
buckets, one for each distance, and the audit is the walk from the start over tight arcs, each time by the least letter.

Rows are sorted by range of (conversation, turn), so a conversation of any size is spread over tasks. One that lies inside a
task and is short is solved there. Of the others, each run of at most ``SEGMENT`` rows is a segment: it gives the costs
between its four states on entry and exit; folds along a conversation's segments turn these into distances at each border;
each segment then walks from each entry state, and a second fold picks the walks that meet. Nothing but such small rows and a
stream for the hash of a conversation (SHA-256 has an order) is brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import map_batches, materialise, table

#: Rows and characters of a segment, at most (a longer row is a segment of its own).
SEGMENT, SEGMENT_CHARS = 4096, 4 << 20
#: White space, ends of sentences, and the pairs of role initials that may follow each other (fixed values).
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = {"su", "ua", "au"}
#: States: start, after system, after user, after assistant. What an insertion or a change of role leads to, and what keeping does.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of a change of role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDING = [0, None, None, 0]
MOST = (1 << 63) - 1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

_INTO_NEXT = [[q for q in range(4) if NEXT[q] == r] for r in range(4)]
_INTO_KEPT = {i: [[q for q, to in moves.items() if to == r] for r in range(4)] for i, moves in KEPT.items()}
_NO_MOVES: list = [[], [], [], []]


def distances(initials: list[str], flags: str, exits: list[int | None]) -> list[list[int]]:
    """Least cost from (rows done, state) to the exits, whose own distances are given (null: no exit).

    ``flags`` has ``x`` for a row that must go, ``t`` for a truncated one. Dial's queue: a node waits in the bucket of its
    distance; one that was reached more cheaply meanwhile is stale and skipped.
    """
    n, base = len(initials), min(d for d in exits if d is not None)
    far = 1 << 62
    dist = [[far] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(i: int, q: int, d: int) -> None:
        if d < dist[i][q]:
            dist[i][q] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append((i, q))

    for q, d in enumerate(exits):
        if d is not None:
            reach(n, q, d - base)
    d = 0
    while d < len(buckets):
        for i, q in buckets[d]:  # an arc without cost leads to a row before, whose node joins this bucket
            if dist[i][q] != d:
                continue
            for p in _INTO_NEXT[q]:
                reach(i, p, d + INSERT)
            if i:
                flag = flags[i - 1]
                reach(i - 1, q, d + DELETE)
                if flag != "x":
                    more = TRUNCATED if flag == "t" else 0
                    for p in _INTO_NEXT[q]:
                        reach(i - 1, p, d + REROLE + more)
                    for p in _INTO_KEPT.get(initials[i - 1], _NO_MOVES)[q]:
                        reach(i - 1, p, d + more)
        buckets[d] = []
        d += 1
    return [[x + base if x < far else x for x in row] for row in dist]


def walk(initials: list[str], flags: str, dist: list[list[int]], q: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits over tight arcs from a state on entry, and the state on exit.

    Insertions at the border belong to the next segment, or here if this is the last one.
    """
    i, n, out = 0, len(initials), []
    while i < n or (last and dist[i][q]):
        here = dist[i][q]
        if i < n and here == DELETE + dist[i + 1][q]:
            out.append("D")
            i += 1
        elif here == INSERT + dist[i][NEXT[q]]:
            out.append("I")
            q = NEXT[q]
        else:
            more, to = (TRUNCATED if flags[i] == "t" else 0), KEPT.get(initials[i], {}).get(q)
            if flags[i] != "x" and to is not None and here == more + dist[i + 1][to]:
                out.append("K")
                q = to
            else:
                out.append("R")
                q = NEXT[q]
            i += 1
    return "".join(out), q


def repaired(audit: str, q: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines that are left when an audit's edits are made."""
    i = 0
    for step in audit:
        if step in "IR":
            q = NEXT[q]
            yield f"{NAMES[q]}:" + (texts[i] if step == "R" else "")
        elif step == "K":
            q = KEPT[roles[i][:1]][q]
            yield f"{roles[i]}:{texts[i]}"
        i += step != "I"


def fault_flags(roles: list[str], texts: list[str], again: set[int]) -> tuple[str, list[int]]:
    """(a flag for each row, counts of blank, duplicate and truncated rows); ``again``: rows that repeat one before the first."""
    seen, flags, counts = set(), [], [0, 0, 0]
    for i, row in enumerate(zip(roles, texts, strict=True)):
        end = row[1].rstrip(BLANKS)[-1:]
        kind = 0 if not end else 1 if row in seen or i in again else 2 if end not in ENDS else None
        seen.add(row)
        flags.append("k" if kind is None else "t" if kind == 2 else "x")
        if kind is not None:
            counts[kind] += 1
    return "".join(flags), counts


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def sha(lines: Iterator[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def solved(conv: int | None, roles: list[str], texts: list[str], turns: tuple) -> tuple:
    """The result row of a whole conversation."""
    initials = [r[:1] for r in roles]
    flags, counts = fault_flags(roles, texts, set())
    dist = distances(initials, flags, ENDING)
    audit, _ = walk(initials, flags, dist, START, True)
    return conv, gaps(*turns), *counts, illegal_pairs(initials), dist[0][START], audit, sha(repaired(audit, START, roles, texts))


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(MOST, most - least + 1 - distinct)


class Run:
    """Rows of one conversation that a task has read and not yet handed on."""

    def __init__(self, conv: int | None):
        self.conv, self.split = conv, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.chars, self.turns = [], [], 0, [None, None, 0]

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            if turn != self.turns[1]:
                self.turns[2] += 1
            self.turns[0] = turn if self.turns[0] is None else self.turns[0]
            self.turns[1] = turn


def first_rows(conv: int | None, roles: list[str], texts: list[str]) -> list[dict]:
    """Where each distinct row of a segment first stands, with a digest that also tells conversations apart."""
    out, seen = [], set()
    for i, (r, t) in enumerate(zip(roles, texts, strict=True)):
        if (r, t) not in seen:
            seen.add((r, t))
            out.append({"place": i, "digest": hashlib.blake2b(f"{conv}:{len(r)}:{r}{t}".encode(), digest_size=16).digest()})
    return out


PIECE = "seg long, roles array<string>, texts array<string>, turns array<long>, firsts array<struct<place int, digest binary>>"


def cut(segment: int, chars: int) -> Callable:
    """Sorted rows of a task to results of the conversations that lie inside it, and segments of the others."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made, now, first, done, out = TaskContext.get().partitionId() << 32, None, True, [], []

        def piece(r: Run) -> None:
            nonlocal made
            out.append({"conv_id": r.conv, "seg": made, "roles": r.roles, "texts": r.texts, "turns": list(r.turns), "firsts": first_rows(r.conv, r.roles, r.texts)})
            made += 1
            r.clear()

        def close(r: Run, inside: bool) -> None:
            nonlocal first
            if r.split or first or not inside:
                piece(r)
            else:
                done.append(solved(r.conv, r.roles, r.texts, r.turns))
            first = False

        def ready() -> dict:
            rows = [dict(zip(names, x, strict=True)) for x in done] + out
            done.clear()
            out.clear()
            fields = [*names, "seg", "roles", "texts", "turns", "firsts"]
            return {f: [x.get(f) for x in rows] for f in fields}

        for b in batches:
            for conv, turn, gone, role, text in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(now, True)
                    now = Run(conv)
                if not gone:
                    if now.roles and (len(now.roles) >= segment or now.chars + len(text) > chars):
                        now.split = True
                        piece(now)
                        yield ready()
                    now.add(turn, role, text)
            yield ready()
        if now is not None:
            close(now, False)
            yield ready()

    return run


def folded(df: DataFrame, order: list, step: Callable, schema: str) -> DataFrame:
    """``step(rows)`` on the stream of a task's rows, conversation by conversation in the given order."""
    sorted_rows = df.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for r in b.to_pylist())
        held: list[dict] = []
        for r in step(rows):
            held.append(r)
            if len(held) == 256:
                yield {k: [x[k] for x in held] for k in held[0]}
                held = []
        if held:
            yield {k: [x[k] for x in held] for k in held[0]}

    return map_batches(sorted_rows, run, schema)


def join_segments(pieces: DataFrame) -> DataFrame:
    """The results of conversations that are in segments; ``pieces`` is a written table."""
    pieces = pieces.select("conv_id", "seg", "roles", "texts", "turns", "firsts")
    placed = pieces.select("seg", F.explode("firsts").alias("f")).select("seg", "f.place", "f.digest")
    origin = placed.groupBy("digest").agg(F.min("seg").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "origin")
    again = placed.join(origin, "digest").where("seg > origin").groupBy("seg").agg(F.collect_list("place").alias("again"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for conv, seg, roles, texts, turns, repeats in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                initials = [r[:1] for r in roles]
                flags, counts = fault_flags(roles, texts, set(repeats or []))
                costs = []
                for exit_state in range(4):
                    dist = distances(initials, flags, [0 if q == exit_state else None for q in range(4)])
                    costs.append([None if x >= 1 << 62 else x for x in dist[0]])
                rows.append((conv, seg, initials, flags, counts + [illegal_pairs(initials)], turns, costs))
            yield dict(zip(("conv_id", "seg", "initials", "flags", "counts", "turns", "costs"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in ("conv_id", "seg", "initials", "flags", "counts", "turns", "costs")}

    shape = "conv_id long, seg long, initials array<string>, flags string, counts array<long>, turns array<long>, costs array<array<long>>"
    known = materialise(map_batches(pieces.join(again, "seg", "left").select("conv_id", "seg", "roles", "texts", "turns", "again"), facts, shape), "segment-facts")

    def backward(rows: Iterator[dict]) -> Iterator[dict]:
        conv, border = object(), None
        for r in rows:
            last = r["conv_id"] != conv
            conv, border = r["conv_id"], ENDING if last else border
            yield {"seg": r["seg"], "exits": border, "last": last}
            border = [min(r["costs"][x][q] + border[x] for x in range(4) if r["costs"][x][q] is not None and border[x] is not None) for q in range(4)]

    borders = folded(known.select("conv_id", "seg", "costs"), [F.desc("seg")], backward, "seg long, exits array<long>, last boolean")

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "seg", "audits", "states", "dist")}
            for conv, seg, initials, flags, exits, last in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                dist = distances(initials, flags, exits)
                found = [walk(initials, flags, dist, q, last) for q in range(4)]
                for k, v in zip(out, (conv, seg, [a for a, _ in found], [s for _, s in found], dist[0]), strict=True):
                    out[k].append(v)
            yield out

    walked = map_batches(known.join(borders, "seg").select("conv_id", "seg", "initials", "flags", "exits", "last"), walks, "conv_id long, seg long, audits array<string>, states array<int>, dist array<long>")

    def forward(rows: Iterator[dict]) -> Iterator[dict]:
        conv, q = object(), START
        for r in rows:
            cost = None
            if r["conv_id"] != conv:
                conv, q, cost = r["conv_id"], START, r["dist"][START]
            yield {"seg": r["seg"], "entry": q, "audit": r["audits"][q], "cost": cost}
            q = r["states"][q]

    chosen = materialise(folded(walked, ["seg"], forward, "seg long, entry int, audit string, cost long"), "segment-walks")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            got = [list(repaired(a, q, roles, texts)) for a, q, roles, texts in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield {"conv_id": b.column(0), "seg": b.column(1), "body": ["\n".join(x).encode() if x else None for x in got]}

    bodies = map_batches(pieces.join(chosen, "seg").select("conv_id", "seg", "audit", "entry", "roles", "texts"), lines, "conv_id long, seg long, body binary")
    parts = bodies.join(known.select("seg", "initials", "counts", "turns").withColumn("ends", F.array(F.try_element_at("initials", F.lit(1)), F.try_element_at("initials", F.lit(-1)))).drop("initials"), "seg").join(chosen.select("seg", "audit", "cost"), "seg")

    def whole(rows: Iterator[dict]) -> Iterator[dict]:
        now: dict | None = None

        def result() -> dict:
            return {"conv_id": now["conv_id"], "gaps": gaps(*now["turns"]), **dict(zip(COUNTS[1:5], now["counts"], strict=True)), "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

        for r in rows:
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield result()
                now = {"conv_id": r["conv_id"], "turns": [None, None, 0], "counts": [0] * 4, "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "end": None, "lines": False}
            now["counts"] = [a + b for a, b in zip(now["counts"], r["counts"], strict=True)]
            if r["ends"][0] is not None:
                now["counts"][3] += now["end"] is not None and now["end"] + r["ends"][0] not in LEGAL
                now["end"] = r["ends"][1]
            least, most, distinct = r["turns"]
            if least is not None:
                held = now["turns"]
                now["turns"] = [least if held[0] is None else held[0], most, held[2] + distinct - (least == held[1])]
            now["audit"].append(r["audit"])
            if r["body"] is not None:
                now["sha"].update(b"\n" * now["lines"] + r["body"])
                now["lines"] = True
        if now is not None:
            yield result()

    return folded(parts.select("conv_id", "seg", "body", "counts", "turns", "ends", "audit", "cost"), ["seg"], whole, RESULT)


def repair(rows: DataFrame, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and gone; rows that are gone only name their conversation. The rows of a
    conversation stand by turn, nulls first, and those of one turn by a hash of role and text, so equal rows are neighbours.
    A null conv_id is a conversation of its own; null roles and texts are one space. Roles count by their first character; one
    that is not s, u or a fits nowhere, and an empty role is such a one. Very long conversations and texts are taken whole.
    Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the hash of an empty text. An
    empty table gives none. Other columns are not read.
    """
    space = F.lit(" ")
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("gone", F.lit(False)).alias("gone"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    named = named.withColumns({"tie": F.xxhash64("role", "text"), "nth": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "tie", "nth"]
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "gone", "role", "text")
    split = materialise(map_batches(ordered, cut(segment, segment_chars), f"{RESULT}, {PIECE}"), "conversation-pieces")
    inside = split.where(F.col("seg").isNull()).select([x.split()[0] for x in RESULT.split(", ")])
    return inside.unionByName(join_segments(split.where(F.col("seg").isNotNull())))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as they stand after damage by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20; ``gone`` marks dropped ones."""
    space = F.lit(" ")
    named = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    dealt = named.withColumn("kind", F.crc32(key) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times)).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
