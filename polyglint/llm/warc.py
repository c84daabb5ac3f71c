"""WARC archives with revisit resolution.

Payload digests are computed where the rows are; only headers (id, digest) are shuffled to
find equal payloads. The largest id of equal payloads keeps its body as ``response``; the
others become ``revisit`` records that refer to it. Archives are written by Spark's text
writer with the record separator of the format, so its commit protocol holds when a task is
repeated, and the result is a few WARC files per task: long records stand in files of their own, so
that a file is bounded by its bytes however unlike the lengths of payloads are.

Cases: a null payload counts as empty; a null id is written as an empty one and sorts before
all others; repeated rows are records of their own, the last in table order being the
response; a null target gives no WARC-Target-URI; line breaks in targets are removed; an
empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, shared_path, sized_join, stable

#: Readers take a file at a time: it holds at most this many records, and payloads of this many bytes or a single one.
RECORDS_PER_FILE, BYTES_PER_FILE = 2_000, 64 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SEPARATOR = "\r\n\r\n"
_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write one record per row; equal payloads of ``min_bytes`` or more are stored once."""
    rows = stable(pages).select(
        F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("pos")
    )
    body = F.col("body").cast("binary")
    rows = rows.withColumns({"digest": base32_sha1(body), "check": F.md5(body), "bytes": F.octet_length("body")})
    # Headers only are shuffled, and combined before that: a payload of any number of copies is one row per map task.
    originals = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "check", "bytes").agg(F.count("*").alias("n"), F.max(F.struct("id", "pos")).alias("first"))
    originals = materialise(originals.filter("n > 1").select("digest", "check", "bytes", "first"), "warc-originals")
    rows = sized_join(rows, originals, ["digest", "check", "bytes"], "left")
    name = lambda id_, pos: F.concat(F.lit("<urn:record:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), pos.cast("string"), F.lit(">"))
    revisit = F.coalesce(F.col("first.pos") != F.col("pos"), F.lit(False))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"), F.col("pos"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Refers-To", F.when(revisit, name(F.col("first.id"), F.col("first.pos")))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(revisit, 0).otherwise(F.col("bytes")) + len(_HTTP)).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.lit(_HTTP), F.when(revisit, "").otherwise(F.col("body")))
    rows = rows.select(record.alias("value"), file_of(F.when(revisit, 0).otherwise(F.col("bytes")), F.monotonically_increasing_id()).alias("size"))
    rows.write.partitionBy("size").option("lineSep", _SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def file_of(size: Column, number: Column) -> Column:
    """Which of a task's files a record belongs to, by its bytes and its number in the task.

    Records of which ``RECORDS_PER_FILE`` fit in a file are together. Of longer ones, those of at most 2 ** k bytes
    share a file if their numbers are among the same ``BYTES_PER_FILE`` / 2 ** k that follow each other.
    """
    k = F.ceil(F.log2(F.greatest(size, F.lit(1))))
    fit = F.greatest(F.floor(BYTES_PER_FILE / F.pow(F.lit(2.0), k)), F.lit(1))
    place = F.floor(number.bitwiseAND((1 << 33) - 1) / fit)  # the lower bits number the rows of a task
    return F.when(size <= BYTES_PER_FILE // RECORDS_PER_FILE, "0").otherwise(F.concat_ws("-", k, place))


def _records(content: bytes) -> Iterator[tuple]:
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            continue  # the blank lines between records
        head: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        block = stream.read(int(head.get("content-length", 0)))
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), digest, head.get("warc-refers-to"), payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; files are read in parallel, records streamed.

    A response whose body doesn't have the digest in its header has ``payload_digest`` null.
    """
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")] + [("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in _records(content.as_py()):
                    if row[1] == "response" and row[3] != b32encode(hashlib.sha1(row[5]).digest()).decode():
                        row = (*row[:3], None, *row[4:])
                    rows.append(row)
                    held += len(row[5])
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(parse, _SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: revisits take them from their response.

    Columns: record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest.
    A revisit without its response keeps its header's digest and has payload_bytes null.
    """
    heads = materialise(records.select("record_id", "record_type", "target_uri", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-heads")
    wanted = heads.filter("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    responses = heads.filter("record_type = 'response'").select("record_id", F.col("payload_digest").alias("full_digest"), F.col("payload_bytes").alias("full_bytes")).join(wanted, "record_id", "left_semi")
    responses = materialise(responses.withColumnRenamed("record_id", "refers_to"), "warc-responses")
    out = sized_join(heads, responses, ["refers_to"], "left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "record_id", "record_type", "target_uri", "refers_to",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("full_digest", "payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def record_key(record_id: Column) -> Column:
    """The row id inside a record id that ``write_archives`` made; null if it was null."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:record:(.*):-?\d+>$", 1), F.lit(""))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives (to a new shared folder unless ``path`` is given) and read them back, resolved."""
    path = path or shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolve(read_archives(pages.sparkSession, path))
