"""Repair of conversations against Dijkstra over every edit, one conversation at a time."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from talus.llm.conversations import damaged, distances, op12_conversation_repair, repair

SHAPE = "conv_id long, turn long, role string, text string, cost string, audit string"


def states(q, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial))


def cheapest(rows, faults):
    """(cost, audit, lines) by best-first search on (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, lines
        if (i, q) in done:
            continue
        done.add((i, q))
        after = 3 if q == 2 else 2
        name = {2: "user", 3: "assistant"}[after]
        heapq.heappush(heap, (cost + 3, audit + "I", i, after, (*lines, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after, (*lines, f"{name}:{text}")))
                if (to := states(q, role[:1])) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))


def brute(table, damage):
    by, turns = {}, {}
    for conv, turn, role, text, *_ in table:
        by.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        faults, seen = [], set()
        for _, role, text in rows:
            end = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = cheapest([r[1:] for r in rows], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(rng, n):
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "No!", "and then", "", " \n", "Why?", f"Text {rng.randrange(9)}.", "Done. \t"])
            out.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), text, "x", None))
            turn += rng.choice([1, 1, 1, 3])
    return out


@pytest.mark.parametrize("segment", [4096, 3, 1])
def test_random_conversations(spark, segment):
    """With short segments every conversation goes through the folds."""
    rows = conversations(random.Random(3), 60)
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert ours(repair(damaged(df), segment=segment)) == brute(rows, True)
    assert ours(repair(df.withColumn("gone", F.lit(False)), segment=segment)) == brute(rows, False)


@pytest.mark.parametrize("segment", [4096, 2])
def test_awkward_rows(spark, segment):
    long = "word " * 50_000
    rows = [
        (None, None, None, None, None, None), (None, 3, "user", "Hi.", "x", "x"), (1, None, "user", None, None, None), (1, None, "user", None, None, None), (1, 5, None, "x.", None, None),
        (1, 9, "assistant", long, None, None), (2, -(2**62), "user", "Hi.", None, None), (2, 2**62, "assistant", long + ".", None, None), (3, 1, "user", "Same.", None, None), (3, 1, "user", "Same.", None, None),
        (-4, 0, "Über", "naïve 日本.", None, None),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    assert ours(repair(damaged(df), segment=segment, segment_chars=1000)) == brute(rows, True)


def test_one_conversation_of_most_rows(spark):
    """It is spread over tasks, with one text that comes again and again."""
    rows = [(7, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 3 else "Again.", None, None) for t in range(900)] + conversations(random.Random(1), 5)
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    assert ours(repair(damaged(df), segment=50)) == brute(rows, True)


def test_empty_table_and_whole_drop(spark):
    assert ours(repair(damaged(spark.createDataFrame([], SHAPE)))) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert ours(repair(damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", None, None)], SHAPE)))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_distances_skip_stale_nodes():
    assert distances(["u", "a"], "kk", [0, None, None, 0])[0][0] == 0
    assert distances(["a"], "k", [0, None, None, 0])[0][0] == 3  # an inserted user before it
    assert distances(["u"], "x", [0, None, None, 0])[0] == [4, 10, 7, 4]


def test_query_shape(spark, data):
    df = op12_conversation_repair(spark, data)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
