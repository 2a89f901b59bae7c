"""WARC archives: writing pages as records, and reading records back with segments put together.

A page becomes one HTTP response whose body is framed in chunks. Where that block is longer than a segment, the record is split: the
first segment is a `response`, the others are `continuation` records that name the first by its identifier and carry their
number, the last one the total length. Pages with equal payloads become `revisit` records of the one with the smallest page_id.

Archives are written by Spark's text sink, compressed, with the record separator as line end, so they lie wherever Spark can write, and are
read as binary files. An archive holds a bounded number of records of bounded length, so one file fits a task. The parser goes by
Content-Length alone; nothing inside a payload can be taken for a record.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspan.llm.common import settle
from tallyspan.session import new_folder

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Characters in a chunk of the HTTP body and in a segment of the block, which ordinary pages exceed; records in an archive.
CHUNK = 4096
SEGMENT = 8_192
RECORDS = 1_000
#: Payloads below this many bytes are never revisited.
LEAST_SHARED = 100


def chunked(text: str) -> str:
    """The text as a chunked HTTP body; chunk sizes count bytes of UTF-8."""
    parts = [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked HTTP body."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[line + 2:line + 2 + size])
        if len(parts[-1]) != size or body[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def _record(kind: str, fields: list[tuple[str, str | None]], block: str) -> str:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + END + block


def _safe(url: str | None) -> str | None:
    """Control characters and spaces cannot stand in a header."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _records(uid: int, page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None) -> Iterator[str]:
    own = f"<urn:page:{'' if page_id is None else page_id}:{uid}>"
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", _safe(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], "HTTP/1.1 200 OK\r\n\r\n")
        return
    block = HTTP_HEAD + chunked(html or "")
    parts = [block[i:i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record("response", fields, block)
        return
    yield _record("response", [*fields, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block.encode())) if n == len(parts) else None
        more = [("WARC-Record-ID", f"<urn:segment:{uid}:{n}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", total)]
        yield _record("continuation", more, part)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as WARC archives under `path`.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of LEAST_SHARED bytes or more, those with the
    smallest page_id are responses and the others revisits; pages without page_id are always responses. Repeated rows are records of
    their own. Urls are written with control characters and spaces escaped, null ones not at all. Other columns are ignored; an empty
    table writes no record.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    shared = rows.filter((F.col("size") >= LEAST_SHARED) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    shared = settle(shared.filter("n > 1").select("digest", "least"), "shared")
    revisit = F.when(F.col("page_id") != F.col("least"), F.col("least"))
    dealt = rows.join(shared, "digest", "left").withColumn("refers_to", revisit)
    dealt = dealt.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[str] = []
            size = 0
            for row in zip(*(batch.column(c) for c in ("uid", "page_id", "url", "html", "digest", "size", "refers_to")), strict=True):
                for record in _records(*(x.as_py() for x in row)):
                    held.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    dealt.mapInArrow(of, "value string").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


RECORD_FIELDS = "kind string, record_id string, target string, digest string, refers_to string, origin string, segment int, total bigint, block binary"
_RECORD_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of an archive as RECORD_FIELDS names them."""
    at = 0
    while at < len(archive):
        end = archive.index(END.encode(), at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record where one should start")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + len(END)
        stop = start + int(head["content-length"])
        if archive[stop:stop + len(END)] != END.encode():
            raise ValueError("a record is not as long as it says")
        own, total = head.get("warc-record-id"), head.get("warc-segment-total-length")
        yield (head["warc-type"], own, head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"),
               head.get("warc-segment-origin-id", own), int(head.get("warc-segment-number", 0)), int(total) if total else None, archive[start:stop])
        at = stop + len(END)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The single records of the archives under `path`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[tuple] = []
                size = 0
                for record in parse(gzip.decompress(content.as_py())):
                    held.append(record)
                    size += len(record[-1])
                    if size > 4_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _RECORD_KINDS, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, RECORD_FIELDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records from segments: rows (kind, record_id, target, digest, refers_to, block, complete).

    Segments are grouped by the identifier of the record they continue and put in order of their number; `complete` says that the numbers run
    from 1 without a hole and that the length is the one that the last segment states. Records without segments are complete and are
    not shuffled. Segments whose first record is missing give a row without record_id that is not complete.
    """
    alone = records.filter("segment = 0").select("kind", "record_id", "target", "digest", "refers_to", "block", F.lit(True).alias("complete"))
    first = F.col("segment") == 1
    joined = records.filter("segment > 0").groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("kind", "record_id", "target", "digest", "refers_to")],
        F.expr("listagg(block) within group (order by segment)").alias("block"), F.count("*").alias("parts"),
        F.sum("segment").alias("numbers"), F.max("segment").alias("last"), F.max("total").alias("total"))
    in_row = (F.col("parts") == F.col("last")) & (2 * F.col("numbers") == F.col("last") * (F.col("last") + 1))
    whole = F.col("record_id").isNotNull() & in_row & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    return alone.unionByName(joined.select("kind", "record_id", "target", "digest", "refers_to", "block", whole.alias("complete")))


def _payload(block: Column) -> Column:
    @F.pandas_udf("binary")
    def of(blocks: pd.Series) -> pd.Series:
        def one(whole: bytes) -> bytes:
            head, _, body = bytes(whole).partition(END.encode())
            return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body

        return pd.Series([one(b) for b in blocks], dtype=object)

    return of(block)


def _digested(block: Column) -> Column:
    """Length and digest of a block's payload; the payload itself stays in the task."""

    @F.pandas_udf("bytes bigint, digest string")
    def of(blocks: pd.Series) -> pd.DataFrame:
        found = []
        for whole in blocks:
            head, _, body = bytes(whole).partition(END.encode())
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            found.append((len(payload), hashlib.sha256(payload).hexdigest()))
        return pd.DataFrame(found, columns=["bytes", "digest"])

    return of(block)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole responses of the archives with their decoded payload: rows (record_id, target, payload)."""
    whole = reassemble(read_records(spark, path)).filter("kind = 'response' and complete")
    return whole.select("record_id", "target", _payload(F.col("block")).alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as the archives hold them: rows (page_id, payload_bytes, payload_digest, record_type, refers_to, intact).

    Length and digest are taken from decoded payloads; a revisit has those of the response it refers to. `intact` says that a record is
    whole and that its digest is the one it states. Revisits whose response is missing are not intact and have no length.
    """
    whole = reassemble(read_records(spark, path))
    page = F.regexp_extract("record_id", "^<urn:page:([0-9-]*)", 1)
    page = F.when(page != "", page).cast("bigint")
    stated = F.regexp_replace("digest", "^sha256:", "")
    refers = F.regexp_extract("refers_to", "^<urn:page:([0-9-]+)", 1).cast("bigint")
    found = whole.filter("kind = 'response'").withColumn("found", _digested(F.col("block"))).select(
        page.alias("page_id"), F.col("found.bytes").alias("payload_bytes"), F.col("found.digest").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"), (F.col("complete") & (F.col("found.digest") == stated)).alias("intact"))
    responses = settle(found, "responses")
    revisits = whole.filter("kind = 'revisit'").select(page.alias("page_id"), stated.alias("payload_digest"), F.lit("revisit").alias("record_type"), refers.alias("refers_to"))
    known = responses.filter("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    resolved = revisits.join(known, ["refers_to", "payload_digest"], "left").withColumn("intact", F.col("payload_bytes").isNotNull())
    return responses.unionByName(resolved.select(responses.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back by `read_pages`."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path)
