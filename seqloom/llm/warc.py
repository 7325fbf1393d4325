"""WARC archives: writing captures, reading them back and assembling transactions.

Each page becomes three records: request, response (or revisit) and metadata. Request and metadata name the response or revisit
in WARC-Concurrent-To. Every record is a gzip member of its own, as the format recommends. Whole members are gathered to archives
of about ``FILE_BYTES`` (a larger record is an archive by itself), one file each, written by Spark's text writer: a file ends with
the writer's line separator, which is an empty gzip member. Reading inflates one record at a time and cuts by Content-Length, so
payloads may hold anything, and a worker holds one archive and one record. Captures are put together again by joining the three
record types on the identifiers.

Of records with equal payloads (by SHA-1 and length) of at least ``min_bytes``, the one with the smallest page_id is the response
and the others revisit it; a revisit names its original by payload digest, target and date (the profile of identical payloads).
Responses and revisits are told apart on digest, length and page_id only; the payloads stay where they are while the payloads that
occur again are few enough to be broadcast (``BROADCAST_ROWS``), else they move once, in a join that Spark may split.

A record is written for every row, also for repeated ones: record ids come from the row's place in the writing task. A null payload
is an empty one; a null url gives records without a target; a null page_id is kept, is never the smallest and, where only null ids
have a payload, all of them are responses. Other columns are ignored; an empty table gives no archives' records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, discarded, fresh_path, record_batch, stored, table, workers_see_package

#: Compressed bytes of an archive; rows with payloads that occur again, of about 100 bytes each, that may be broadcast.
FILE_BYTES, BROADCAST_ROWS = 32_000_000, 200_000
#: Compressed bytes inflated at once.
PIECE = 8192
#: An empty gzip member: what Spark's writer puts behind each archive.
END_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
CRLF = "\r\n"
#: Written as every record's date: captures have none.
DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, target string, refers_to_target string, payload_digest string, payload_bytes long, fields map<string, string>, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if at > 1 else []) + [F.substring(h, at, n)]], F.lit(">"))


def _record(kind: Column | str, id_: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), id_), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]  # a null value drops the header
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, size, first and first_url (smallest page_id with that payload; null where it occurs once or is small)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    page = page.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    same = page.where(F.col("size") >= min_bytes).groupBy("digest", "size")
    # min skips nulls, so a null id is never the first
    firsts = same.agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f")).where("n > 1")
    firsts = stored(firsts.select("digest", "size", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "repeated-payloads")
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return page.join(F.broadcast(firsts) if few else firsts, ["digest", "size"], "left")


def _archives(file_bytes: int):
    """Gathers the records of many captures, each record a gzip member, to archives of ``file_bytes``."""
    schema = pa.schema([("value", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for records in zip(*(as_bytes(c) for c in batch.columns), strict=True):
                for record in records:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    held.append(member.compress(record + b"\r\n\r\n") + member.flush())
                    size += len(held[-1])
                if size >= file_bytes:
                    yield record_batch(schema, [b"".join(held)])
                    held, size = [], 0
        if held:
            yield record_batch(schema, [b"".join(held)])

    return pack


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one capture per row of ``pages`` (page_id, url, html) to gzipped WARC files in the folder ``path``."""
    workers_see_package(pages.sparkSession)
    c = captures(pages, min_bytes).withColumn("row", F.monotonically_increasing_id().cast("string"))
    own = _urn(F.lit("capture"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", "row")
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.col("page_id").isNull() & F.col("first").isNotNull())
    target, first = F.regexp_replace("url", "[\\r\\n]", ""), F.regexp_replace("first_url", "[\\r\\n]", "")
    digest = F.concat(F.lit("sha1:"), "digest")
    reply = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    asked = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    kind = F.when(revisit, "revisit").otherwise("response")
    again = [(k, F.when(revisit, v)) for k, v in (("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", F.lit(DATE)), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))]
    records = [
        _record("request", _urn(F.lit("request"), own), [("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        _record(kind, own, [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), *again, ("Content-Type", F.lit("application/http;msgtype=response"))], F.when(revisit, reply).otherwise(F.concat(reply, "html"))),
        _record("metadata", _urn(F.lit("metadata"), own), [("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields),
    ]
    packed = c.select(*[r.alias(f"r{k}") for k, r in enumerate(records)]).mapInArrow(_archives(file_bytes), "value binary")
    # the text writer writes the bytes as they are; one value is one file
    text = packed.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", END_MEMBER.decode("latin-1"))
    text.option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after the other; an archive that is not compressed is one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, held = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            held.append(unpack.decompress(view[at : at + PIECE]))  # pieces, as what stands behind a member is copied
            at += PIECE
        at = min(at, len(view)) - len(unpack.unused_data)
        yield b"".join(held)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; a member may hold one record or several."""
    for text in members(data):
        at = 0
        while at < len(text):
            end = text.index(b"\r\n\r\n", at)
            version, *lines = text[at:end].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["content-length"])
            yield headers, text[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``; see ``RECORD`` for the columns.

    payload is what follows the HTTP header of a response; payload_bytes and payload_digest are measured on it and must agree with
    the record's header. A revisit has the digest of its header and neither payload nor length.
    """
    workers_see_package(spark)
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target", pa.string()), ("refers_to_target", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def row(h: dict[str, str], block: bytes) -> dict:
        kind, digest = h["warc-type"], (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        out = {"record_id": h["warc-record-id"], "type": kind, "concurrent_to": h.get("warc-concurrent-to"), "target": h.get("warc-target-uri"), "refers_to_target": h.get("warc-refers-to-target-uri"), "payload_digest": digest}
        if kind == "metadata":
            out["fields"] = [tuple(x.split(": ", 1)) for x in block.decode().split(CRLF) if ": " in x]
        elif kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            measured = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, measured):
                raise ValueError(f"payload of {h['warc-record-id']} has digest {measured}, not {digest}")
            out |= {"payload_digest": measured, "payload_bytes": len(payload), "payload": payload}
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[dict] = []
                size = 0
                for h, block in parse(batch.column("content")[i].as_buffer().to_pybytes()):
                    rows.append(row(h, block))
                    size += len(block)
                    if len(rows) == 1000 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, reply, request and metadata (structs), joined through concurrent-to identifiers.

    ``records`` is read once for each record type, so store it first, without payloads where they are not asked for: a payload goes
    through the join with its reply.
    """
    held = ["payload"] if "payload" in records.columns else []
    reply = records.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct("type", "target", "refers_to_target", "payload_digest", "payload_bytes", *held).alias("reply"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return reply.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def resolved(nested: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture: revisits meet the response with their digest."""
    page_id = F.expr("try_cast(metadata.fields['page-id'] as long)")
    flat = stored(nested.select(page_id.alias("page_id"), F.col("reply.payload_bytes").alias("payload_bytes"), F.col("reply.payload_digest").alias("payload_digest"), F.col("reply.type").alias("record_type")), "captures")
    responses = flat.where("record_type = 'response'")
    # one row for each payload that is revisited; only revisits join, and a payload with many is split by the skew join
    wanted = flat.where("record_type = 'revisit'").select("payload_digest").distinct()
    first = stored(responses.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("size")), "originals")
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = flat.where("record_type = 'revisit'").join(F.broadcast(first) if few else first, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(again.withColumn("payload_bytes", F.col("size")).select(columns))


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and assemble what is read back, with or without payloads."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    discarded(spark, path)
    records = read_archives(spark, path)
    return transactions(records if payloads else stored(records.drop("payload"), "records"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(round_trip(table(spark, sf_dir, "pages"), payloads=False))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(3, -1, -1), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(hex, 1 + 5 * CAST(k AS BIGINT), 5) AS BIGINT) >> (5 * j)) % 32 AS BIGINT), 1)), lambda a, x: a || x)), lambda a, x: a || x) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
