"""A content-addressed WARC archive.

Each payload's bytes are stored once, in the response record of the smallest id that has
them; every other record of the same payload is a revisit. Exact record headers are kept
in a table of their own, and original records come back by joining headers to payloads on
the digest. Equal payloads are told by SHA-256 and length; the SHA-1 that the format
names is recomputed from the bytes when an archive is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polysense.llm.common import batch_of, rows_of
from polysense.sources.store import materialize, scratch_path

# fixed values of the format
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_DATE = "2000-01-01T00:00:00Z"
#: payload bytes per archive file
FILE_BYTES = 32 << 20


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal digest: five digits make four characters."""
    out = []
    for i in range(8):
        number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*out)


def record_uri(page_id: Column, row_key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex(row_key)), F.lit(">"))


def keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``(row_key, page_id, url, payload, sha256)``: the key is a digest of id, address and payload digest."""
    rows = rows_of(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                       F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex("sha256"), "url")
    return rows.withColumn("row_key", F.substring(F.unhex(F.sha2(name.cast("binary"), 256)), 1, 16))


def decide(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records ``(row_key, page_id, url, copies, payload_bytes, payload_digest, sha256, record_type, refers_*)`` of ``keyed`` rows.

    Payloads below ``min_bytes`` are always responses. Hashing is narrow; only digests
    and addresses are shuffled, and the first id of a digest is found with map-side
    combining, so a payload that a third of the pages share stays spread out.
    """
    data = F.col("payload").cast("binary")
    index = rows.select("row_key", "page_id", "url", F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("sha1"), "sha256")
    keys = ["row_key", "page_id", "url", "payload_bytes", "sha1", "sha256"]
    index = materialize(index.groupBy(*keys).agg(F.count("*").alias("copies")), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_key")
    heads = index.groupBy("sha256", "payload_bytes").agg(F.min(order).alias("head"))
    first = (F.col("row_key") == F.col("head.row_key")) | (F.col("payload_bytes") < min_bytes)
    return index.join(heads, ["sha256", "payload_bytes"]).select(
        "row_key", "page_id", "url", "copies", "payload_bytes", base32_of_hex(F.col("sha1")).alias("payload_digest"), "sha256",
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("head.page_id")).alias("refers_to"), F.when(~first, F.col("head.row_key")).alias("refers_key"))


def headers(decided: DataFrame) -> DataFrame:
    """Adds ``header``: the record's exact header block, without the empty line that ends it."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    parts = [
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_uri(F.col("page_id"), F.col("row_key"))),
        line("WARC-Date", F.lit(CAPTURE_DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x1F]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_uri(F.col("refers_to"), F.col("refers_key"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return decided.withColumn("header", F.concat(*parts))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> None:
    """Write archive files and the header table of ``pages`` under ``path``.

    A null payload is empty, and so is a null address. Rows equal in id, address and
    payload are one record, whose header row counts the copies. A null id is written as
    ``none`` and is first for its payload only if no other row has it. An empty table
    gives an archive without records. Files hold about ``FILE_BYTES`` of payload each;
    Spark's own writer commits them, so a lost executor leaves no partial record.
    """
    rows = keyed(pages, id_col, url_col, payload_col)
    decided = materialize(headers(decide(rows, min_bytes)), "decided")
    total = decided.agg(F.sum("payload_bytes").alias("bytes"), F.count("*").alias("n")).first()
    files = max(1, -(-((total["bytes"] or 0) + 512 * total["n"]) // FILE_BYTES))
    # one shuffle of the payloads, dealt as the files are
    bodies = rows.select("row_key", "payload").repartition(files, "row_key").groupBy("row_key").agg(F.first("payload").alias("payload"))
    placed = bodies.join(decided.select("row_key", "record_type", "header").repartition(files, "row_key"), "row_key")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    placed.select(F.concat("header", F.lit(END), body).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").text(os.path.join(path, "warc"))
    decided.select("row_key", "page_id", "copies", "header", "payload_digest", "sha256").write.parquet(os.path.join(path, "headers"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Records of an archive file: fields, exact header block, body; found by their lengths alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        block = data[at:end]
        lines = block.decode("utf-8").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield fields, block, data[start:stop]
        at = stop + 4


RECORD = "row_key binary, page_id long, record_type string, payload_digest string, refers_to long, sha256 binary, payload binary"
_RECORD = pa.schema([("row_key", pa.binary()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                     ("refers_to", pa.int64()), ("sha256", pa.binary()), ("payload", pa.binary())])
_BATCH_BYTES = 8 << 20


def _page(uri: str) -> tuple[int | None, bytes]:
    page, key = uri.removeprefix("<urn:page:").removesuffix(">").split(":")
    return None if page == "none" else int(page), bytes.fromhex(key)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            rows, size = [], 0
            for fields, block, body in parse_records(gzip.decompress(packed.as_py())):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                page, key = _page(fields["WARC-Record-ID"])
                rows.append((key, page, fields["WARC-Type"], digest, _page(fields["WARC-Refers-To"])[0] if "WARC-Refers-To" in fields else None,
                             hashlib.sha256(body).digest() if response else None, body if response else None))
                size += len(body) + len(block)
                if size > _BATCH_BYTES:
                    yield batch_of(_RECORD, *zip(*rows))
                    rows, size = [], 0
            if rows:
                yield batch_of(_RECORD, *zip(*rows))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: payloads of responses, null for revisits. Digests are verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(os.path.join(path, "warc"))
    return files.select("content").mapInArrow(_read, RECORD)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Original records ``(page_id, header, record_type, refers_to, payload_digest, payload_bytes, payload, copies)``.

    Every header is joined to a stored copy of its payload by the SHA-256 that was
    recomputed from the archived bytes.
    """
    records = read_archive(spark, path)
    bodies = records.filter("record_type = 'response'").select("row_key", "sha256", "payload")
    once = bodies.join(bodies.groupBy("sha256").agg(F.min("row_key").alias("row_key")), ["sha256", "row_key"]).select("sha256", "payload")
    return _with_headers(spark, path, records, once.withColumn("payload_bytes", F.octet_length("payload").cast("long"))).select(
        "page_id", "header", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "copies")


def _with_headers(spark: SparkSession, path: str, records: DataFrame, bodies: DataFrame) -> DataFrame:
    kinds = records.select("row_key", "record_type", "refers_to", "payload_digest")
    table = spark.read.parquet(os.path.join(path, "headers")).select("row_key", "page_id", "copies", "header", "sha256")
    return table.join(kinds, "row_key").join(bodies, "sha256")


def restored_index(spark: SparkSession, path: str) -> DataFrame:
    """``restore`` without the payload bytes: their lengths are taken where the archive is read."""
    records = materialize(read_archive(spark, path).select(
        "row_key", "record_type", "refers_to", "payload_digest", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    lengths = records.filter("record_type = 'response'").groupBy("sha256").agg(F.first("payload_bytes").alias("payload_bytes"))
    return _with_headers(spark, path, records, lengths).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "copies")


def page_rows(index: DataFrame) -> DataFrame:
    """``restored_index`` with one row for every row of the source, instead of ``copies``.

    All rows of the page that stores a payload are responses: its records under other
    addresses, which the archive writes as revisits, refer to no other page.
    """
    own = F.coalesce(F.col("refers_to") == F.col("page_id"), F.lit(False))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", F.when(own, "response").otherwise(F.col("record_type")).alias("record_type"),
        F.when(~own, F.col("refers_to")).alias("refers_to"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive of ``pages``, read it back, and return the restored index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path)
    return restored_index(spark, path)
