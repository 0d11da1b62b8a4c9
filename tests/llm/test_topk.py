"""The index against every inner product."""

import math

import numpy as np
from pyspark.sql import functions as F

from talus.llm import topk


def brute(rows, k=10, every=100):
    out = set()
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    most = 2**63 - 1
    for q, v in good:
        if q % every == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -most), most), i) for i, w in good if i != q)[:k]
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


def test_embeddings(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert set(map(tuple, topk.op10_topk(spark, data).collect())) == brute(rows)


def test_clusters_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.1).round(2).tolist()) for i in range(3000)]
    rows += [(i, rows[7][1]) for i in range(3000, 3300)]  # one vector many times: ties
    rows += [(5000, None), (5001, [None] * 6), (5002, [float("nan")] * 6), (5003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (5100, []), (None, rows[0][1]), (-100, rows[1][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, pivot string").withColumn("r", F.lit(0))
    assert set(map(tuple, topk.search(df).collect())) == brute(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df).collect())) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 0)]
    assert topk.search(df.limit(0)).collect() == [] and topk.search(df.where("vec_id = 0")).collect() == []


def test_shorter_vectors_count_as_followed_by_zeros(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 1.0]), (1, [1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 5.0])], "vec_id long, embedding array<double>")
    one = 1024 * 1024
    assert sorted(map(tuple, topk.search(df).collect())) == [(0, 1, 3, 8 * one), (0, 2, 2, 2 * one), (0, 3, 1, one)]


def test_scores_beyond_a_double_and_a_long(spark):
    rng = np.random.default_rng(5)
    for size in (1e5, 1e9, 1e30):
        rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(400)] + [(900, []), (901, [1e308]), (1000, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert set(map(tuple, topk.search(df).collect())) == brute(rows)


def test_only_empty_vectors(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df).collect())) == [(0, 1, 1, 0), (0, 2, 2, 0)]
