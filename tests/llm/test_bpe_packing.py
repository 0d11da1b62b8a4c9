"""Ids against the tokenizers library; pieces of packed documents against the ids."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    "", " ", "  a  b ", "don't we'll I'M", "a\n\n b\t\tc \n", " x 　y", "naïve 日本語 \U0001f600\U0001f600", "<|endoftext|>x <|endoftext|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "3.14159 1e-9 ----- ???", "é ​ zero\u0000nul", "ǅ ß ſ İ", " \r\n \v\f ",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_ids_and_decoded_texts(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = bpe.op1_bpe(spark, data).collect()
    assert len(found) == docs.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, text[r.doc_id]) for r in found)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("with_ranks", [False, True])
def test_odd_texts(library, text, with_ranks):
    c = bpe.codec(bpe.default_vocabulary(), packing.ranks_beside() if with_ranks else None)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(c.encode(text), "<u4").tolist() == ids
    assert c.decode(c.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_is_the_text(spark, awkward):
    encoded = bpe.encode(awkward, bpe.default_vocabulary())
    assert encoded.count() == 12
    back = {r.doc_id: r.text for r in bpe.decode(encoded, bpe.default_vocabulary()).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in awkward.collect())


def check_packing(rows, ids_of):
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0
        assert r.doc_tokens == len(ids_of[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        per_doc[r.doc_id].append((r.start, r.length))
        per_seq[r.sequence_id].append((r.offset, r.length))
    for parts in (*per_seq.values(), *per_doc.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    sizes = [sum(n for _, n in p) for p in per_seq.values()]
    assert max(sizes, default=0) <= 1024
    assert {d: sum(n for _, n in p) for d, p in per_doc.items()} == {d: len(i) for d, i in ids_of.items()}
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) / max(1, sum(sizes))


def test_packing_covers_each_id_once(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert check_packing(packing.op7_packing(spark, data).collect(), ids) < 0.01


def test_packing_awkward(spark, awkward, library):
    some = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in some.collect()}
    check_packing(packing.pack_documents(some, bpe.default_vocabulary()).collect(), ids)
    whole = packing.pack_documents(awkward, bpe.default_vocabulary())
    assert whole.where("start = 0").count() == awkward.count()
    assert packing.pack_documents(awkward.limit(0), bpe.default_vocabulary()).collect() == []


def test_limits_hold_together(spark):
    examples = spark.range(3000).select(F.col("id").alias("example_id"), (F.col("id") % 97 + 1).alias("n_tokens"), (F.col("id") % 31).alias("loss_from"))
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=120)
    found = packing.pack_examples(examples, limits).join(examples, "example_id")
    loss = F.greatest(F.col("length") - F.col("loss_from"), F.lit(0))
    per = found.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("s"), F.sum(loss).alias("l"))
    assert found.count() == 3000 and per.where("t > 256 or s > 5 or l > 120").count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "a"])
def test_very_long_runs(spark, library, run):
    text = "x" + run * 1_000_000
    ids = library.encode(text[:50_000], add_special_tokens=False).ids
    c = bpe.codec(bpe.default_vocabulary(), packing.ranks_beside())
    assert np.frombuffer(c.encode(text[:50_000]), "<u4").tolist() == ids
    whole = c.encode(text)
    assert c.decode(whole) == text
    rows = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.default_vocabulary(), ranks=packing.ranks_beside()).collect()
    check_packing(rows, {1: [*np.frombuffer(whole, "<u4").tolist(), 0]})
