"""WARC archives: written as one gzip stream a file, then normalised to one gzip member a record with an offset index.

Files are written and read by Spark alone, so any store that Spark reaches will do. The text writer puts a separator after
each row: a record's closing blank lines when the monolithic files are written, and a zero byte for the normalised ones,
whose members end in a zero byte (the top byte of a size below 16 MiB; a larger record is followed by an empty member).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import map_batches, materialise, shared_dir, table

END = b"\r\n\r\n"
#: Bytes that are inflated at a time.
STEP = 1 << 20
#: Records of one archive, and plain bytes (a larger record has one of its own), at most.
ARCHIVE_RECORDS = 5_000
ARCHIVE_BYTES = 64 << 20


def record(page_id: int | None, url: str | None, payload: str, digest: str, response: bool, refers_to: int | None) -> str:
    """A record without its closing blank lines. A revisit has the digest and length of its payload, and not the payload."""
    body = payload if response else ""
    name = f"{page_id}|{url}|{digest}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload.encode())}",
    ]
    if not response:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + body


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines) if k}


def inflate(content: bytes) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, a piece at a time."""
    d = zlib.decompressobj(31)
    while content:
        piece = d.decompress(content, STEP)
        yield piece
        content = d.unconsumed_tail
        if d.eof:
            content, d = d.unused_data, zlib.decompressobj(31)
    yield d.flush()


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, each with its closing blank lines, holding one record at a time."""
    held = bytearray()
    need = None
    for piece in stream:
        held += piece
        while True:
            if need is None:
                at = held.find(END)
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def member(data: bytes) -> bytes:
    """One gzip member that ends in a zero byte; without a time stamp, so equal records give equal bytes."""

    def one(x: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    whole = one(data)
    return whole if whole.endswith(b"\0") else whole + one(b"")


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, response_id) of each page; ``response_id`` is the largest page id with that payload.

    Digests are counted with partial sums and written out; only digests that occur more than once are joined back, and
    Spark splits a digest that holds many pages. Payloads below ``min_bytes`` are all responses. A null payload is empty;
    a null page id never is the largest; rows that repeat the largest id are all responses.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("payload")
    )
    digest = F.sha1(F.encode("payload", "UTF-8"))
    seen = rows.where(F.octet_length("payload") >= min_bytes).select(digest.alias("digest"), "page_id")
    last = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id")).where("n > 1").drop("n")
    last = materialise(last, "warc-digests")
    return rows.withColumn("digest", digest).join(last, "digest", "left")


def write_monolithic(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``revisits`` rows as WARC files, each one gzip stream of a bounded size.

    A task counts the bytes of its records and starts another ``part`` where they reach the bound; very long pages are
    records like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = size = 0
        for b in batches:
            out, parts = [], []
            for page_id, url, payload, digest, last in zip(*(b.column(i) for i in range(5)), strict=True):
                page_id, last = page_id.as_py(), last.as_py()
                sha1 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                out.append(record(page_id, url.as_py(), payload.as_py(), sha1, last is None or page_id == last, last))
                n = len(out[-1].encode()) + len(END)
                if size and size + n > archive_bytes:
                    part, size = part + 1, 0
                size += n
                parts.append(part)
            yield {"value": out, "part": parts}

    rows = map_batches(pages.select("page_id", "url", "payload", "digest", "response_id"), run, "value string, part int")
    files = rows.write.partitionBy("part").option("lineSep", END.decode()).option("compression", "gzip")
    files.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def archive_name(path: str) -> str:
    """The name of a monolithic file: its part and file name, without the endings of its format.

    What Spark puts before these tells a task's files of one part apart (``.c000``, ``.c001``: 5,000 records each).
    """
    part, name = path.rsplit("/", 2)[-2:]
    return f"{part.removeprefix('part=')}-{name.removesuffix('.gz').removesuffix('.txt')}"


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite every archive under ``source``: ``target/archive=N/kind=warc`` has a member a record, ``kind=index`` their places.

    Each file is inflated once, in one task, a step at a time. An index line has offset, length, record id, type, digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).where("length > 0").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name, offset, index = archive_name(path), 0, []
                out: list[bytes] = []
                for r in records(inflate(content.as_py())):
                    h, m = headers(r[: r.find(END)]), member(r)
                    index.append(f"{offset} {len(m)} {h['warc-record-id']} {h['warc-type']} {h['warc-payload-digest']}")
                    offset += len(m)
                    out.append(m[:-1])
                    if sum(map(len, out[-64:])) > STEP or len(out) >= 512:
                        yield {"archive": [name] * len(out), "kind": ["warc"] * len(out), "value": out}
                        out = []
                yield {"archive": [name] * len(out), "kind": ["warc"] * len(out), "value": out}
                yield {"archive": [name], "kind": ["index"], "value": [member("\n".join(index).encode())[:-1]]}

    # A task's rows come file by file; the index follows its records, and this order needs no sorting but by the two keys.
    rows = map_batches(files, run, "archive string, kind string, value binary")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).sortWithinPartitions("archive", "kind", "at").drop("at")
    rows.withColumn("value", F.col("value").cast("string")).write.option("lineSep", "\0").partitionBy("archive", "kind").text(target)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of normalised archives, each inflated from the place its index gives.

    (archive, offset, length, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload): the digest of
    a response is computed anew and must equal its header's; a revisit has its header's, and a null payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    part = F.regexp_extract("path", r"archive=([^/]*)/kind=([^/]*)/", 1).alias("archive")
    kind = F.regexp_extract("path", r"archive=([^/]*)/kind=([^/]*)/", 2).alias("kind")
    files = files.select(part, kind, "content")
    index = files.where("kind = 'index'").select("archive", F.col("content").alias("places"))
    both = files.where("kind = 'warc'").drop("kind").join(index, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for name, content, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                view = memoryview(content.as_buffer())
                lines = b"".join(inflate(places.as_py())).decode().splitlines()
                for at in range(0, len(lines), 256):
                    rows: dict[str, list] = {k: [] for k in ("archive", "offset", "length", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")}
                    for line in lines[at : at + 256]:
                        offset, length, *_ = line.split(" ")
                        offset, length = int(offset), int(length)
                        data = b"".join(inflate(bytes(view[offset : offset + length])))
                        head = data.find(END)
                        h = headers(data[:head])
                        digest, size, payload = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), None
                        if h["warc-type"] == "response":
                            raw = data[head + 4 : head + 4 + int(h["content-length"])]
                            if base64.b32encode(hashlib.sha1(raw).digest()).decode() != digest:
                                raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                            payload, size = raw.decode("utf-8"), len(raw)
                        refers = h.get("x-refers-to-page-id")
                        row = (name, offset, length, int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], h["warc-type"], digest, size, int(refers) if refers else None, payload)
                        for k, v in zip(rows, row, strict=True):
                            rows[k].append(v)
                    yield rows

    return map_batches(
        both,
        run,
        "archive string, offset long, length long, page_id long, url string, record_type string, payload_digest string,"
        " payload_bytes long, refers_to long, payload string",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, members = shared_dir(spark, "warc-monolithic"), shared_dir(spark, "warc")
    write_monolithic(revisits(table(spark, sf_dir, "pages")), whole)
    normalise(spark, whole, members)
    return read_archives(spark, members).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"
    )
