"""Content-addressed WARC archive.

An archive is two Parquet tables under one path: ``payloads`` holds each distinct payload once, under its SHA-256;
``headers`` holds the exact header bytes of every record with the key of its payload.  Records come back by joining the two, and
``export_warc`` writes them as gzipped WARC files, which ``read_warc`` parses by Content-Length.  Stored bytes are checked against
their key on every read, parsed ones against the digest in their header; a mismatch raises.

Defined results: a null html is an empty payload; a null url leaves out WARC-Target-URI; repeated rows each give a record (all of
the largest page_id are responses); records whose page_id is null are responses only where no payload twin has an id; an empty
table gives empty tables and no record.  Columns beyond page_id, url, html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, release, shared_dir, table

CRLF = "\r\n"
#: Payloads below this many bytes are always stored as responses.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, record_type, content_key, header (binary): what each page's record says, without its payload."""
    base = hashed(pages).drop("payload")
    winners = base.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("content_key").agg(F.max("page_id").alias("response_id"))
    r = base.join(winners, "content_key", "left")
    is_response = (F.col("payload_bytes") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("response_id"))
    r = r.withColumn("record_type", F.when(is_response, "response").otherwise("revisit"))
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    revisit = F.col("record_type") == "revisit"

    def line(name, value):
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return r.select("page_id", "record_type", "content_key", header.cast("binary").alias("header"))


def hashed(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"").cast("binary")).alias("payload"))
    return p.withColumns({"content_key": F.sha2("payload", 256), "payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write the archive of ``pages`` at ``path``.  Equal payloads are combined before the shuffle, so a hot payload moves once per task."""
    distinct = hashed(pages).groupBy("content_key").agg(F.first("payload").alias("payload"))
    _write(distinct, lambda w: w.option("compression", "zstd").parquet(f"{path}/payloads"))
    _write(records(pages, min_revisit_bytes).select("content_key", "header"), lambda w: w.parquet(f"{path}/headers"))
    return path


def _write(df: DataFrame, save) -> None:
    """Save, and let Spark remove the shuffle files of the write when it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        save(df.write)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("content_key")
    return p.select("content_key", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its key "), F.col("content_key"))).cast("binary")).alias("payload"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """content_key, record (the record's exact bytes, CRLF CRLF included) and payload (for revisits that of the response)."""
    r = spark.read.parquet(f"{path}/headers").join(_payloads(spark, path), "content_key", "left")
    revisit = F.contains(F.decode("header", "UTF-8"), F.lit(f"{CRLF}WARC-Type: revisit{CRLF}"))
    block = F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return r.select("content_key", F.concat("header", block, F.lit(b"\r\n\r\n").cast("binary")).alias("record"), "payload")


def export_warc(spark: SparkSession, path: str, to: str) -> str:
    """Write the archive's records as gzipped WARC files through Spark's text sink, which writes any Hadoop path."""
    r = reconstruct(spark, path)
    record = F.expr("substring(record, 1, length(record) - 2)").cast("string")  # the sink's separator is the last CRLF
    _write(r.select(record.alias("value")), lambda w: w.option("lineSep", CRLF).option("compression", "gzip").text(to))
    return to


def parse_warc(data: bytes):
    """Yield (header bytes, block bytes) of each record of an uncompressed WARC file, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        n = next(int(x[15:]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if data[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        yield header, data[end : end + n]
        at = end + n + 4


_FIELD = re.compile(r"^([A-Za-z-]+): ([^\r\n]*)\r$", re.M)
_PAGE = re.compile(r"<urn:page:(-?[0-9]+)>")
PARSED = "page_id long, url string, record_type string, refers_to long, block_bytes long, digest string"


def parsed_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the WARC files at ``path``: header fields, length of the block, digest of the payload as the header gives it.

    The block of a response is hashed and held against its header.
    """

    def page(text):
        m = _PAGE.fullmatch(text or "")
        return int(m.group(1)) if m else None

    def work(batches):
        names = [x.split()[0] for x in PARSED.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                out: list[list] = [[] for _ in names]
                for header, block in parse_warc(gzip.decompress(content.as_py())):
                    f = dict(_FIELD.findall(header.decode("utf-8")))
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"record {f['WARC-Record-ID']}: its block doesn't match its digest")
                    row = (page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), kind, page(f.get("WARC-Refers-To")), len(block), digest)
                    for column, v in zip(out, row):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), work, PARSED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the WARC files at ``path``.

    A revisit takes its payload from the response that it refers to and whose digest it gives; without one it raises.
    """
    r = parsed_records(spark, path)
    held = r.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "digest", F.col("block_bytes").alias("held_bytes")).distinct()
    revisits = r.where("record_type = 'revisit'").join(held, ["refers_to", "digest"], "left")
    n = F.coalesce("held_bytes", F.raise_error(F.concat(F.lit("no response holds the payload of page "), F.col("page_id").cast("string"))).cast("long"))
    shown = lambda df, size: df.select("page_id", "url", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return shown(r.where("record_type = 'response'"), F.col("block_bytes")).union(shown(revisits, n))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), shared_dir(spark, "archive"))
    files = export_warc(spark, path, shared_dir(spark, "warc"))
    return read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH b AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM b),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM r
"""
