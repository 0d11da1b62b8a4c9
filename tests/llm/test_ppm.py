"""Byte-model scores against a trie of dictionaries, and the unigram base against counting."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from talus.llm import ppm
from talus.llm.ppm import op13_lm_score, scores

SHAPE = "doc_id long, text string, learn boolean, score string, split string, keys string"


def trie(texts, order):
    nodes = defaultdict(Counter)
    for t in texts:
        b = bytes([0xFE]) * order + t + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                nodes[b[i - k : i]][b[i]] += 1
    return nodes


def cost(nodes, context, symbol, order):
    total, gone = 0.0, set()
    for k in range(order, -1, -1):
        node = nodes.get(context[len(context) - k :])
        left = {s: n for s, n in (node or {}).items() if s not in gone}
        if not left:
            continue
        most = 2 * sum(left.values())
        if symbol in left:
            return total + math.log10((2 * left[symbol] - 1) / most)
        total += math.log10(len(left) / most)
        gone |= set(left)
    return total - math.log10(256 - len(nodes.get(b"", {})))


def score(nodes, t, order):
    b = bytes([0xFE]) * order + t + b"\xff"
    return sum(cost(nodes, b[i - order : i], b[i], order) for i in range(order, len(b)))


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, order=ppm.ORDER):
    learned = [t or "" for _, t, learn, *_ in rows if learn]
    nodes, counts = trie([t.encode() for t in learned], order), Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, learn, *_ in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, not learn, len(ws), sum(counts[w] > 0 for w in ws), n, base, score(nodes, (t or "").encode(), order)))
    return sorted(out, key=repr)


def same(df, wanted):
    got = sorted(map(tuple, df.collect()), key=repr)
    got.sort(key=lambda r: repr(r[:5]))
    wanted = sorted(wanted, key=lambda r: repr(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for key in {r[:5] for r in got}:
        for at, near in ((5, 1e-9), (6, 1e-6)):
            assert sorted(r[at] for r in got if r[:5] == key) == pytest.approx(sorted(r[at] for r in wanted if r[:5] == key), rel=near, abs=1e-6)


def prose(rng, n):
    words = ["the", "Theory", "of", "things", "über", "日本", "a", "ing", "\n", "then,", "x" * 30]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), i % 3 > 0, "x", None, "y") for i in range(n)]


def test_random_texts(spark):
    rows = prose(random.Random(2), 80)
    same(scores(spark.createDataFrame(rows, SHAPE).repartition(5)), brute(rows))


def test_small_windows_and_sums(spark, monkeypatch):
    """Texts that are cut into windows and counts that are summed up on the way give the same."""
    rows = prose(random.Random(4), 30)
    keys = ppm.grams([r[1].encode() for r in rows])
    whole = [c for codes, _ in keys for c in codes.tolist()]
    monkeypatch.setattr(ppm, "WINDOW", 64)
    monkeypatch.setattr(ppm, "PENDING", 10)
    assert [c for codes, _ in ppm.grams([r[1].encode() for r in rows]) for c in codes.tolist()] == whole
    s = ppm.Sums()
    for codes, _ in ppm.grams([r[1].encode() for r in rows]):
        ppm.counted(s, codes, codes % 2 == 0)
    wanted = Counter(c for c in whole if c % 2 == 0) | Counter({c: 0 for c in whole})
    found, counts = s.done()
    assert found.tolist() == sorted(set(whole)) and counts.tolist() == [wanted[c] for c in found.tolist()]


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in awkward.collect()]
    from pyspark.sql import functions as F

    from talus.llm.common import id_bucket

    same(scores(awkward.drop("score").withColumn("learn", id_bucket("doc_id", 7) != 2)), brute(rows))
    assert scores(awkward.withColumn("learn", F.lit(True)).limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    rows = [(1, "ab", False, None, None, None), (2, None, False, None, None, None), (2, None, None, None, None, None)]
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scores(spark.createDataFrame(rows, SHAPE)).collect())
    even = -math.log10(256)
    assert [g[:5] for g in got] == [(1, 2, 0, 0, 0.0), (2, 1, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert [g[5] for g in got] == pytest.approx([3 * even, even, even])


def test_probabilities_of_a_context_add_up():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(50)).encode() for _ in range(20)]
    nodes = trie(texts, ppm.ORDER)
    for context in (b"abc a", b"zzzzz", b"\xfe" * 5, b"zzzab"):
        assert sum(10 ** cost(nodes, context, s, ppm.ORDER) for s in range(256)) == pytest.approx(1)


def test_query(spark, data):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = op13_lm_score(spark, data)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    short = [r for r in rows if len(r[1] or "") < 400]
    counts = Counter(w for _, t, learn in rows if learn for w in tokens(t))
    nodes, n, v = trie([(t or "").encode() for _, t, learn in rows if learn], ppm.ORDER), sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows) and len(short) > 10
    for i, t, learn in short:
        ws = tokens(t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not learn, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert got[i].score == pytest.approx(score(nodes, (t or "").encode(), ppm.ORDER), rel=1e-6)
