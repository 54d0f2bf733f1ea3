"""WARC archives: a writer of one gzip member per record and a sequential reader.

Writing: payloads are hashed where they are read; of the digests only those that occur twice or more are joined back with their largest page
id, so payloads stay where they are while such digests are few. Each task turns its rows into gzip members and rolls its archives at about ROLL
bytes; Spark's own committer writes the files, so a retried task leaves no double records, on any store that Spark can write. Spark writes
binary rows to files only as lines of text: a member's last byte, which is zero, is left to stand as the line end, and the cast to string takes
the bytes as they are. Reading: each archive is decompressed member by member in small steps, framed by Content-Length, and every
response's digest is verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import cut, fresh_path, table, text_batches

STEP = 64 << 10
LEVEL = 3
EMPTY_MEMBER_LEVEL = 1
#: Bytes of members after which a task begins another archive; a reader holds one archive at a time.
ROLL = 128 << 20
#: So many repeated digests (20 bytes and an id each) at most are broadcast; with more they meet the payloads in a shuffle.
PICK_ROWS = 400_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no block; its payload's length stands in a header of its own."""
    name = lambda i: f"<urn:gridspark:page:{'none' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html"]
    if not response:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if response else b""
    head.append(f"Content-Length: {len(block)}")
    out = member("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n")
    # Archives are written with a zero byte as line end, which stands for the last byte of the member. That byte is zero for
    # records below 16 MB; larger ones are followed by an empty member, which readers skip.
    return out if out[-1] == 0 else out + member(b"", EMPTY_MEMBER_LEVEL)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, inflated in steps of at most STEP bytes; empty ones are skipped."""
    z, out = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            out += z.decompress(chunk, STEP)
            chunk = z.unconsumed_tail
            if z.eof:
                chunk = z.unused_data
                if out:
                    yield bytes(out)
                z, out = zlib.decompressobj(31), bytearray()
        while not z.eof and (more := z.decompress(b"", STEP)):
            out += more
    if out:
        raise ValueError("the archive ends within a member")


def parse(data: bytes) -> dict:
    """Headers and block of one record, framed by Content-Length; the digest of a response's payload is verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    n = int(h["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from Content-Length")
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and digest32(block) != digest:
        raise ValueError("the payload's digest differs")
    number = lambda x: None if x is None or x.endswith(":none>") else int(x.rstrip(">").rpartition(":")[2])
    return {"page_id": number(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload": block, "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To"))}


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record per row under path. A null html is an empty payload; of equal payloads that with the largest page_id
    is the response (rows that repeat it are responses too) and the others revisit it; a null page_id counts as smallest. A very long
    payload is a record like others. An empty table gives archives without records; other columns are not stored."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = text_batches(pages).select(F.col(page_id).cast("long").alias("i"), F.col(url).cast("string").alias("u"), body.alias("p")).withColumn("h", F.sha1("p"))
    again = cut(rows.groupBy("h").agg(F.max("i").alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first", F.lit(True).alias("again")))
    typed = rows.join(F.broadcast(again) if again.count() <= PICK_ROWS else again, "h", "left")
    response = F.col("again").isNull() | F.col("i").eqNullSafe(F.col("first"))
    typed = typed.select("i", F.when(response, F.col("p")).alias("p"), F.octet_length("p").alias("n"), "h", "u", "first")

    def packed(batches):
        archive = held = 0
        for b in batches:
            out, at = [], []
            for i, p, n, h, u, first in zip(*b.columns, strict=True):
                d = base64.b32encode(bytes.fromhex(h.as_py())).decode("ascii")
                out.append(record(i.as_py(), u.as_py(), p.as_py() if p.is_valid else b"\0" * n.as_py(), d, p.is_valid, first.as_py())[:-1])
                at.append(archive)
                held += len(out[-1])
                if held >= ROLL:
                    archive, held = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["archive", "value"])

    members_ = typed.mapInArrow(packed, "archive int, value binary").select("archive", F.col("value").cast("string").alias("value"))
    members_.write.mode("errorifexists").partitionBy("archive").option("lineSep", "\0").text(path)


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
KIND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under path, one archive per task at a time, in small batches. A damaged archive fails the read.

    payload=False leaves the payloads out once they are verified. A path without archives gives no records.
    """

    def unpacked(batches):
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                view = memoryview(content.as_buffer())
                for data in members(bytes(view[k : k + STEP]) for k in range(0, len(view), STEP)):
                    r = parse(data)
                    size += len(r["payload"])
                    if not payload:
                        r["payload"] = None
                    held.append(r)
                    if size > 16 << 20 or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, KIND)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, KIND)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(unpacked, RECORD)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: the hex digest's bits are cut into groups of five, which name letters of the alphabet.
SQL = """
WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
d AS (SELECT page_id, octet_length(p)::BIGINT AS n, sha1(p) AS h FROM b),
x AS (SELECT DISTINCT h, list_transform(range(1, 41, 5), lambda i: ('0x' || h[i:i + 4])::BIGINT) AS w FROM d),
e AS (SELECT h, list_aggregate(list_transform(w, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31)::INT + 1]), 'string_agg', '')), 'string_agg', '') AS digest FROM x),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM m JOIN e USING (h)
"""
