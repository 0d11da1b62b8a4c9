"""Archives against payload digests worked out in Python, and against Python's gzip."""

import base64
import glob
import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from talus.llm import warc


def expected(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = {}
    for page, html in rows:
        b = (html or "").encode()
        last = max(groups[b])
        revisit = len(b) >= min_bytes and page != last
        out[page] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
    return out


def found(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = warc.op5_warc(spark, data)
    assert got.count() == pages.count()
    assert found(got) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_members_stand_alone_and_index_finds_them(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 100), (2, "http://a/ b\r\nc", "x" * 100), (3, None, None), (4, "u", ""), (5, "u", "naïve \r\n\r\n \x01 日本"), (6, "u", "y" * 3_000_000), (7, "u", "xy")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1)).withColumn("payload", F.lit("no"))
    whole, members = str(tmp_path / "whole"), str(tmp_path / "members")
    warc.write_monolithic(warc.revisits(pages), whole)
    warc.normalise(spark, whole, members)
    back = warc.read_archives(spark, members)
    assert found(back) == expected([(r[0], r[2]) for r in rows])
    assert {r.page_id: r.payload for r in back.where("record_type = 'response'").collect()}[5] == rows[4][2]
    sources = {warc.archive_name(p): gzip.open(p).read() for p in glob.glob(f"{whole}/part=*/*.gz")}
    for archive in glob.glob(f"{members}/archive=*"):
        name = archive.split("=")[-1]
        data = b"".join(open(p, "rb").read() for p in glob.glob(f"{archive}/kind=warc/part-*"))
        assert gzip.decompress(data) == sources[name]
        index = gzip.decompress(b"".join(open(p, "rb").read() for p in glob.glob(f"{archive}/kind=index/part-*"))).decode().splitlines()
        at = 0
        for line in index:
            offset, length = map(int, line.split(" ")[:2])
            assert offset == at
            assert gzip.decompress(data[offset : offset + length]).startswith(b"WARC/1.1\r\n")
            at += length
        assert at == len(data)


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert [r.response_id for r in warc.revisits(pages, 3).orderBy("page_id").collect()] == [None, None, 4, 4]


def test_awkward_ids(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a"), (1, "u", "a"), (2, None, "a"), (2, None, "a")], "page_id long, url string, html string")
    whole, members = str(tmp_path / "w"), str(tmp_path / "m")
    warc.write_monolithic(warc.revisits(pages), whole)
    warc.normalise(spark, whole, members)
    kinds = sorted((r.page_id or 0, r.record_type) for r in warc.read_archives(spark, members).collect())
    assert kinds == [(0, "revisit"), (1, "revisit"), (2, "response"), (2, "response")]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    whole, members = str(tmp_path / "w"), str(tmp_path / "m")
    warc.write_monolithic(warc.revisits(pages), whole)
    warc.normalise(spark, whole, members)
    assert warc.read_archives(spark, members).collect() == []


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "z" * (40_000 if i == 3 else 300)) for i in range(1, 41)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    whole, members = str(tmp_path / "w"), str(tmp_path / "m")
    warc.write_monolithic(warc.revisits(pages), whole, 5_000)
    sizes = [len(gzip.open(p).read()) for p in glob.glob(f"{whole}/part=*/*.gz")]
    assert len(sizes) > 5 and sum(n > 5_000 for n in sizes) == 1
    warc.normalise(spark, whole, members)
    assert found(warc.read_archives(spark, members)) == expected([(r[0], r[2]) for r in rows])


def test_records_over_several_batches(spark, tmp_path):
    rows = [(i, "u", str(i % 1700)) for i in range(2_500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    whole, members = str(tmp_path / "w"), str(tmp_path / "m")
    warc.write_monolithic(warc.revisits(pages), whole)
    warc.normalise(spark, whole, members)
    assert found(warc.read_archives(spark, members)) == expected([(r[0], r[2]) for r in rows])


def test_files_of_one_task_and_part_are_archives_of_their_own(spark, tmp_path):
    rows = [(i, "u", f"{i % 11_000} " + "z" * (i % 97)) for i in range(12_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    whole, members = str(tmp_path / "w"), str(tmp_path / "m")
    warc.write_monolithic(warc.revisits(pages).coalesce(1), whole)
    files = glob.glob(f"{whole}/part=0/*.gz")
    assert len(files) == 3 and len({warc.archive_name(p) for p in files}) == 3
    warc.normalise(spark, whole, members)
    back = warc.read_archives(spark, members)
    assert sorted(r["count"] for r in back.groupBy("archive").count().collect()) == [2_000, 5_000, 5_000]
    assert found(back) == expected([(r[0], r[2]) for r in rows])
