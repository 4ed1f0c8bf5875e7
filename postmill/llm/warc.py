"""WARC archives with revisit resolution.

Headers (digest, length, id, address) are shuffled by payload digest and pre-aggregated to the first
record of each payload; pages then join the digests that occur more than once. The first becomes the
``response``, the others ``revisit`` records without payload that refer to it. Records get fresh headers: type,
identity, date (of writing, or a column's), address, digests and lengths; nothing is taken over from elsewhere.

Each record is a gzip member of its own, so readers can seek to it. Tasks pack members into archives of about ``FILE_BYTES``
(a larger record is an archive of its own), led by a ``warcinfo`` record. An archive is one row that Spark's committed
text writer puts into one file, on any file system; the line end that this writer adds is an empty gzip member. A lost
task leaves nothing half-written.

Reading parses each archive member by member in a stream, checks every digest, and resolves revisits by joining them to the responses on the
payload digest: only revisits' headers and the responses that are referred to are shuffled. A payload that a third of all
captures share is one row on the response side; adaptive execution splits the other side.

Defined results: ids are percent-encoded in headers, so any text comes back as it was; null html is an empty payload; null addresses have no target header; a null id
never is the first while another has the payload; rows that repeat the first record's id are
responses too, under the same record id; a null date is the time of writing; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import new_path, spill

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which an archive is closed: the bound of a file, and of what a task holds of it.
FILE_BYTES = 16 << 20
#: A gzip member without content, as text in Latin-1.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
_ID = "urn:page:"
#: The name of records without an id, which no encoded id can have.
NO_ID = "<urn:no-page>"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 5 hexadecimal digits make 4 symbols."""
    digits = F.sha1(payload)
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda g: F.conv(F.substr(digits, g * 5 + 1, F.lit(5)), 16, 10).cast("int"),
    )
    letters = F.transform(
        groups,
        lambda v: F.concat(
            *[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        ),
    )
    return F.array_join(letters, "")


def resolve_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (id, url, payload, date) with digest, n_bytes and, for revisits, the first one's id, url and date."""
    headed = pages.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload"))
    first = (
        headed.filter(F.col("n_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url", "date")).alias("first"))
        .filter("copies > 1")
        .select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"), F.lit(True).alias("shared"))
    )
    joined = headed.join(spill(first, "warc-first"), "digest", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("revisit", revisit).drop("shared")


def _address(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def record_text() -> Column:
    """A record without its end: fresh headers, empty line, block."""
    name = lambda c: F.coalesce(F.concat(F.lit(f"<{_ID}"), F.url_encode(c.cast("string")), F.lit(">")), F.lit(NO_ID))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    optional = lambda key, value: F.coalesce(line(key, value), F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", name(F.col("first_id"))),
        optional("WARC-Refers-To-Target-URI", _address(F.col("first_url"))),
        optional("WARC-Refers-To-Date", F.col("first_date")),
    )
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.col("date")),
        optional("WARC-Target-URI", _address(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF + CRLF),
    )


def pack(batches: Iterator[pa.RecordBatch], file_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """Records as archives: a gzip member each, the ``warcinfo`` record first."""
    fields = f"software: postmill{CRLF}format: WARC File Format 1.1{CRLF}"

    def head() -> bytes:
        headers = (
            f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}WARC-Date: {date}{CRLF}"
            f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(fields)}{CRLF}{CRLF}"
        )
        return gzip.compress((headers + fields + CRLF + CRLF).encode(), mtime=0)

    def archive(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([head() + b"".join(members)], pa.binary())], names=["value"])

    members, size = [], 0
    for batch in batches:
        for record in batch.column(0):
            member = gzip.compress(record.as_py().encode("utf-8", "surrogatepass"), compresslevel=6, mtime=0)
            if members and size + len(member) > file_bytes:
                yield archive(members)
                members, size = [], 0
            members.append(member)
            size += len(member)
    if members:
        yield archive(members)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date_col: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write ``pages`` as archives below ``path``; ``date_col`` is the time of capture, if there is one."""
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    written = F.lit(now)
    if date_col:
        written = F.coalesce(F.date_format(F.to_utc_timestamp(F.col(f"`{date_col}`").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), written)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"),
        written.alias("date"),
    )
    records = resolve_first(rows, min_bytes).select(record_text().alias("value"))
    archives = records.mapInArrow(lambda batches: pack(batches, file_bytes, now), "value binary")
    writer = archives.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("compression", "none").text(path)


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a binary stream."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[key.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} has no end")
        yield headers, block


_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; response payloads are checked against their digest."""

    def local(name: str | None) -> str | None:
        return urllib.parse.unquote_plus(name[1 + len(_ID) : -1]) if name and name != NO_ID else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for headers, block in parse_archive(gzip.open(io.BytesIO(content.as_py()))):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {headers['warc-record-id']} differs from its digest")
                    fields = dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:])
                    rows.append(
                        {
                            "id": local(headers["warc-record-id"]),
                            "record_type": kind,
                            "url": headers.get("warc-target-uri"),
                            "digest": digest,
                            "n_bytes": int(fields["Content-Length"]),
                            "refers_to": local(headers.get("warc-refers-to")),
                            "payload": payload if payloads and kind == "response" else None,
                        }
                    )
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema(
        [("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()),
         ("n_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, _RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payload of the original response on every revisit."""
    revisits = records.filter("record_type = 'revisit'")
    asked = revisits.select("digest").distinct()
    originals = (
        records.filter("record_type = 'response'")
        .join(asked, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min_by("payload", "id").alias("original"))
    )
    filled = revisits.join(originals, "digest", "left").withColumn("payload", F.col("original")).select(*records.columns)
    return records.filter("record_type = 'response'").unionByName(filled)


def op10(pages: DataFrame) -> DataFrame:
    """Contract digest of an archive round trip."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    id_type = pages.schema["page_id"].dataType
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).select(
        F.col("id").cast(id_type).alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
           AS payload_digest
  FROM d),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM b GROUP BY payload_digest)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
       CASE WHEN b.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM b JOIN f USING (payload_digest)
"""
