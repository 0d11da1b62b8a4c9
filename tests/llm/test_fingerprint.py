"""Fingerprints against shingle sets worked out in Python."""

import hashlib
import re

from pyspark.sql import functions as F

from talus.llm import fingerprint as fp


def sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_estimates(spark, data):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    found = {r.doc_id: r for r in fp.op2_fingerprints(spark, data).collect()}
    assert len(found) == len(docs)
    error = []
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sets(text), sets(edited), sets(following)
        error += [abs(r.near_edited - jaccard(a, b)), abs(r.near_next - jaccard(a, c)), abs(r.shingles - len(a)) / max(1, len(a)) / 4]
    assert max(error) < 0.2 and sum(error) / len(error) < 0.02


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(2000))
    whole = fp.add_sketch(spark.createDataFrame([("k", text)], "k string, t string"), "t", "s").first().s
    words = text.split()
    parts = [("k", " ".join(words[i : i + 104])) for i in range(0, 2000, 100)] + [("none", None)]
    df = fp.add_sketch(spark.createDataFrame(parts, "k string, t string"), "t", "s")
    merged = {r.k: r.s for r in fp.merge_parts(df, "k", "s").withColumnRenamed("sketch", "s").collect()}
    assert merged == {"k": whole, "none": []}


def test_awkward(spark, awkward):
    rows = fp.fingerprints_with_edits(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == ""
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_edited >= 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fp.fingerprints_with_edits(awkward.limit(0)).collect() == []
    one = fp.fingerprints_with_edits(awkward.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_no_python_on_the_way(spark, data):
    plan = fp.op2_fingerprints(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_containment(spark):
    df = spark.createDataFrame([("a b c d e f g h", "a b c d e f g h i j k l")], "x string, y string")
    df = fp.add_sketch(fp.add_sketch(df, "x", "sx"), "y", "sy")
    r = df.select(fp.containment(F.col("sx"), F.col("sy")).alias("xy"), fp.containment(F.col("sy"), F.col("sx")).alias("yx")).first()
    assert abs(r.xy - 1) < 1e-9 and abs(r.yx - 0.5) < 1e-9


def test_rows_without_ids_and_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fp, "GROUP_ROWS", 4)
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(i, f"other {i}") for i in range(40)] + [(None, "null 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, order = fp.in_id_order(docs, "doc_id", "text")
    own = dealt.where("not guest")
    assert own.count() == len(rows)
    assert own.groupBy("g").count().agg(F.max("count")).first()[0] <= 20
    led = dealt.withColumn("next", F.struct(F.lead("doc_id").over(order), F.lead("text").over(order))).where("not guest").collect()
    found = {(r.doc_id, r.text): tuple(r.next) for r in led if r.text != "null 3"}
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    repeated = [i for i, _ in rows].count(7) > 1
    key = lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]] if r[0] is None or (repeated and r[0] == 7) else 0, r[1])
    order = sorted(rows, key=key)
    for i, row in enumerate(order):
        if row[1] != "null 3":
            assert found[row] == order[(i + 1) % len(order)], row
