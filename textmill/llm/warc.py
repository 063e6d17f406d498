"""WARC archives: writing captures, reading them back, and assembling transactions.

Writing: each page becomes three records, a request, a response (or revisit) and a metadata
record; the request and the metadata name the response in ``WARC-Concurrent-To``.  Of pages
with equal payloads that with the largest id is the response and the others are revisits
that name it in ``WARC-Refers-To`` and carry no payload.  The records of a page are one row
of Spark's text writer, whose line separator is the blank line that ends a record, so files
are committed as those of any Spark job, on any Hadoop file system.

Reading: archives are binary files; records are cut out by their ``Content-Length`` inside
Arrow batches, payloads are measured and their SHA-1 is compared with the stated one.

Assembly: requests and metadata are joined to responses through concurrent-to identifiers,
and revisits to the response they refer to: one nested row for each capture.

Defined cases: null html is an empty payload; a null url is empty and control characters in
urls are percent-encoded; a null id loses against any id; rows that repeat id and payload
are captures of their own, the first a response if the id is the largest; records without a
partner leave a null struct; an empty table gives an archive without records and an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, table

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CAPTURES_PER_FILE = 2_000  # bounds what one task reads at once
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, content_type string, "
          "stated_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary")
ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                   ("target_uri", pa.string()), ("content_type", pa.string()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 40 bits of the digest are 10 hex and 8 base-32 digits."""
    sha = F.sha1(payload)
    eight = lambda k: F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[eight(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts) -> Column:
    """A record identifier from what the record is of."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind, record_id: Column, url: Column, content_type: str, block: Column, *more: Column) -> Column:
    """The bytes of a record but for the blank line after it."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
                    url, F.lit(f"\r\nContent-Type: {content_type}"), *more, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head.cast("binary"), block)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archive ``pages`` under ``path`` as gzip files of WARC records."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    small = pages.select(F.col(id_col).cast("long").alias("i"), F.unhex(F.sha2(payload, 256)).alias("d")).groupBy("i", "d").agg(F.lit(1).alias("one"))
    largest = small.groupBy("d").agg(F.max("i").alias("rep"))
    # a key without nulls, so that join and window share one exchange of the payloads
    key = F.coalesce(F.col("i").cast("string"), F.lit("")).alias("k")
    marks = cut(small.join(largest, "d").select(key, "d", "rep"), "warc-marks")
    rows = pages.select(F.col(id_col).cast("long").alias("i"), payload.alias("p"), F.unhex(F.sha2(payload, 256)).alias("d"),
                        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("u"))
    rows = rows.select("*", key).join(marks, ["k", "d"])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k", "d").orderBy("u")))
    first = F.col("i").eqNullSafe(F.col("rep")) & (F.col("n") == 1)
    rows = rows.withColumn("first", first).withColumn("sha", base32_sha1(F.col("p")))
    own, url, size = _urn(F.lit("capture"), F.col("i"), F.hex("d"), F.col("n")), F.col("u"), F.octet_length("p").cast("string")
    about = F.concat(F.lit("\r\nWARC-Concurrent-To: "), own)
    host, where = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(where.startswith("/"), where).otherwise(F.concat(F.lit("/"), where)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END)).cast("binary")
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha"))
    again = F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), _urn(F.lit("capture"), F.col("rep"), F.hex("d"), F.lit(1)))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("i").cast("string"), F.lit("")), F.lit("\r\n")).cast("binary")
    gap = F.lit(END).cast("binary")
    records = F.concat(
        _record("request", _urn(F.lit("request"), own), url, "application/http; msgtype=request", asked.cast("binary"), about), gap,
        _record(F.when(F.col("first"), "response").otherwise("revisit"), own, url, "application/http; msgtype=response",
                F.when(F.col("first"), F.concat(answer, F.col("p"))).otherwise(answer), digest, F.when(F.col("first"), "").otherwise(again)), gap,
        _record("metadata", _urn(F.lit("metadata"), own), url, "application/warc-fields", fields, about))
    (rows.select(records.cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path))


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _inflated(content: bytes) -> bytes:
    """All gzip members of an archive, or the archive as it is."""
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(rest))
        rest = member.unused_data
    return b"".join(out) if out else content


def parse(content: bytes, keep_payload: bool) -> Iterator[tuple]:
    """Records of an archive, in file order."""
    data = io.BytesIO(_inflated(content))
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines after a record
        lines = []
        while (line := data.readline().rstrip(b"\r\n")):
            lines.append(line)
        head = _fields(lines)
        block = data.read(int(head.get("content-length", 0)))
        kind, fields = head.get("warc-type"), {}
        body = block
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            fields = _fields(top.split(b"\r\n")[1:]) | {":first": top.split(b"\r\n")[0].decode("utf-8", "replace")}
        elif head.get("content-type") == "application/warc-fields":
            fields = _fields([x for x in block.split(b"\r\n") if x])
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response" and stated not in (None, digest):
            raise ValueError(f"payload of {head.get('warc-record-id')} doesn't have its stated digest")
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
               head.get("content-type"), stated, len(body), digest, list(fields.items()), body if keep_payload else None)


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for r in parse(content.as_py(), keep_payload):
                    rows.append(r)
                    held += r[7] if keep_payload else 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def transactions(records: DataFrame, keep: dict[str, list[str]] | None = None) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata and, for revisits, original.

    ``keep`` names the fields of a part that its struct has; all of a record without it.
    """
    part = lambda kind: F.struct(*(keep or {}).get(kind, records.columns)).alias(kind)
    answers = records.filter("type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.col("refers_to").alias("of"), part("response"))
    about = lambda kind: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias(f"{kind}_of"), part(kind))
    whole = answers.join(about("request"), F.col("capture_id") == F.col("request_of"), "left").join(about("metadata"), F.col("capture_id") == F.col("metadata_of"), "left")
    whole = whole.select("capture_id", "of", "response", "request", "metadata")
    firsts = whole.filter("response.type = 'response'").select(
        F.col("capture_id").alias("first_id"), F.struct("capture_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
                                                        F.col("metadata.fields").alias("fields")).alias("original"))
    return whole.join(firsts, F.col("of") == F.col("first_id"), "left").select("capture_id", "response", "request", "metadata", "original")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    needed = {"response": ["type", "payload_bytes", "payload_digest"], "request": ["type"], "metadata": ["fields"]}
    got = transactions(cut(read_records(spark, path, keep_payload=False), "warc-records"), needed)
    page = lambda fields: F.nullif(F.try_element_at(fields, F.lit("page-id")), F.lit("")).cast("long")
    again = F.col("response.type") == "revisit"
    return got.select(page(F.col("metadata.fields")).alias("page_id"),
                      F.when(again, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
                      F.when(again, F.col("original.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
                      F.col("response.type").alias("record_type"),
                      F.when(again, page(F.col("original.fields"))).alias("refers_to"))


# DuckDB has no base32; digests are compared with hashlib in the tests.
