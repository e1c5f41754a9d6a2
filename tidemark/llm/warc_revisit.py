"""Web archives without repeated payloads: revisit records resolved by payload digest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, need, new_path

#: Payload bytes below which a record is always written in full.
LEAST_BYTES = 1000
#: Payload bytes that one archive file takes, about.
FILE_BYTES = 24 << 20
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def files_of(pages: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Archive files that the payloads fill, about."""
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0))).first()[0]
    return max(1, -(-int(size) // file_bytes))


def resolve(pages: DataFrame, files: int, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, html)`` -> those, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Headers (digest and id) are shuffled by digest and meet the original of their digest there; a digest
    that very many pages share is a skewed join key, which AQE splits. Only then do the revisits' headers
    meet the payloads, which are shuffled once, evenly by id and digest over ``files`` partitions. Null html
    is an empty payload. Rows that repeat the largest page_id are all responses; of a digest whose
    page_ids are all null, so are all.
    """
    p = need(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    p = p.withColumn("slot", F.concat_ws(":", F.col("page_id").cast("string"), "payload_digest"))
    large = p.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest", "slot")
    heads = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"))
    repeats = large.join(heads, "payload_digest").where(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
    repeats = repeats.select("slot", "original").repartition(files, "slot").groupBy("slot").agg(F.max("original").alias("refers_to"))
    joined = p.repartition(files, "slot").join(repeats, "slot", "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")


def _one_line(c) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ")


def record_text(date: str) -> Column:
    """A record with fresh headers, but for the two line ends that close it."""
    def uri(of):
        return F.concat(F.lit("<urn:tidemark:page:"), F.coalesce(of.cast("string"), F.lit("none")), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")), F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def write_archives(resolved: DataFrame, path: str, date: str | None = None) -> None:
    """One gzip-compressed archive per partition, written by Spark's text writer.

    Its line separator is the CRLF CRLF that closes a WARC record, so that the files are plain WARC. ``date``
    is the WARC-Date of all records: the time of writing, if none is given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved.select(record_text(date).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of an uncompressed archive that arrives in chunks."""
    buffer, at = bytearray(), 0

    def fill(upto: int) -> bool:
        while len(buffer) < upto:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0:
            if not fill(len(buffer) + 1):
                if bytes(buffer[at:]).strip():
                    raise ValueError("a WARC record has no end of headers")
                return
            end = buffer.find(b"\r\n\r\n", at)
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a WARC record is cut short")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        at = end + 8 + size
        if at > 1 << 22:
            del buffer[:at]
            at = 0


def _chunks(raw: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a (possibly multi-member) gzip file."""
    while raw:
        d = zlib.decompressobj(31)
        at = 0
        while not d.eof and at < len(raw):
            out = d.decompress(raw[at : at + (1 << 18)])
            at += 1 << 18
            if out:
                yield out
        raw = d.unused_data + raw[at:] if d.eof else b""


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: page_id, url, type, header fields, and the content as it is stored."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(uri: str | None) -> int | None:
            tail = (uri or "").rstrip(">").rpartition(":")[2]
            return int(tail) if tail.lstrip("-").isdigit() else None

        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "content", "content_digest"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for h, content in parse_records(_chunks(batch.column(0)[i].as_py())):
                    rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), number(h.get("WARC-Refers-To")), content, hashlib.sha1(content).hexdigest()))
                    held += len(content)
                    if held > 4 << 20 or len(rows) >= 2048:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, content binary, content_digest string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record read, with ``payload_bytes`` and ``payload_digest`` of the content that stands for it.

    A response's are those of its own content. A revisit is joined to the response that it refers to by id and
    digest, and has that response's; where the archives hold no such response, its two fields are null.
    """
    own = F.col("record_type") == "response"
    heads = records.select("page_id", "record_type", "refers_to", F.when(own, F.length("content").cast("long")).alias("read_bytes"),
                           F.when(own, F.col("content_digest")).otherwise(F.col("payload_digest")).alias("digest"))
    heads = materialize(heads, "records")
    originals = heads.where(own).select(F.col("page_id").alias("original"), "digest", F.col("read_bytes").alias("original_bytes"))
    originals = originals.join(heads.where(~own).select(F.col("refers_to").alias("original"), "digest").distinct(), ["original", "digest"], "left_semi").distinct()
    found = heads.where(~own).join(originals.withColumnRenamed("original", "refers_to"), ["refers_to", "digest"], "left")
    columns = ["page_id", F.coalesce("read_bytes", "original_bytes").alias("payload_bytes"), F.when(own | F.col("original_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), "record_type", "refers_to"]
    return heads.where(own).withColumn("original_bytes", F.lit(None).cast("long")).select(*columns).union(found.select(*columns))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as deduplicated archives, read them back, and describe each record by the content read for it."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(resolve(pages, files_of(pages)), path)
    return resolve_revisits(read_archives(spark, path))
