"""Components against all pairs compared in Python."""

import random
import re

from talus.llm import jaccard
from talus.llm.common import Workspace
from talus.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    ids = sorted(s)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(s[a] & s[b])
            if i and 100 * i >= 75 * (len(s[a]) + len(s[b]) - i):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert found(jaccard.op8_jaccard_join(spark, data)) == brute(rows)


def test_planted_copies_and_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows, next_id = [], 1
    for size in (2, 3, 40, 90):  # groups of near copies, some beyond and some within the threshold
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((next_id, " ".join(t)))
            next_id += 1
    for n in (1, 5, 10, 20, 25, 30, 60) * 6:  # texts that share one passage and little else
        t = [rng.choice(vocabulary) for _ in range(n)]
        rows.append((next_id, " ".join(t[: n // 2] + passage + t[n // 2 :])))
        next_id += 1
    for _ in range(10):
        rows.append((next_id, rows[3][1]))
        next_id += 1
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(0, 60, 6):  # each is near the next only
        rows.append((next_id, " ".join(chain[k : k + 100])))
        next_id += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(jaccard.join(df)) == brute(rows)


def test_short_texts_at_the_threshold(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 4]) for _ in range(rng.randint(1, 14)))) for i in range(250)]
    assert found(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def linked_groups(spark, sets):
    """The groups that the recursion alone joins, with all of each set taken as shared."""
    rows = spark.createDataFrame([(k, len(s), sorted(s)) for k, s in sets.items()], "node long, n long, items array<bigint>")
    work = Workspace(spark, "test")
    by = dict(map(tuple, components(jaccard.Join(work, rows).run()).collect()))
    return {k: by.get(k, k) for k in sets}


def expected_groups(sets):
    ids = sorted(sets)
    by = {i: i for i in ids}
    for a in ids:
        for b in ids:
            i = len(sets[a] & sets[b])
            if a < b and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                old, new = max(by[a], by[b]), min(by[a], by[b])
                by = {k: new if v == old else v for k, v in by.items()}
    return by


def test_a_crowd_around_a_pivot_that_is_in_another_cell(spark):
    p, copies, variants = 10, range(20, 40), range(50, 64)
    sets = {p: set(range(20))} | {c: set(range(20)) for c in copies} | {x: {0, *range(100, 119)} for x in variants}
    assert linked_groups(spark, sets) == expected_groups(sets)


def test_cells_within_cells(spark):
    rng = random.Random(3)
    base, sets = list(range(60)), {}
    for k in range(160):  # a crowd near one base; some near each other outside it, at sizes around the threshold
        kept = set(rng.sample(base, rng.randint(38, 60)))
        extra = {1000 + 40 * (k % 9) + j for j in range(rng.randint(0, 20))}
        sets[k] = kept | extra
    for k in range(160, 190):
        sets[k] = set(rng.sample(range(60), rng.randint(20, 30))) | set(rng.sample(range(2000, 2040), rng.randint(25, 38)))
    assert linked_groups(spark, sets) == expected_groups(sets)


def test_an_id_with_two_texts_is_one_document(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abc"}
    rows = [(1, text["a"]), (7, text["a"]), (7, text["b"]), (9, text["b"]), (5, text["c"]), (5, text["c"]), (4, None), (4, text["c"])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 26, 1), (4, 0, 4), (4, 26, 4), (5, 26, 4), (5, 26, 4), (7, 26, 1), (7, 26, 1), (9, 26, 1)]


def test_awkward(spark, awkward):
    rows = jaccard.join(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[6] == (1, 5) and by[None] == (2, None) and by[-50] == (2, -50)
    assert jaccard.join(awkward.limit(0)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    by = dict(map(tuple, components(spark.createDataFrame(rows, "u long, v long")).collect()))
    assert by == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
