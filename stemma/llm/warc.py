"""WARC records in a content-addressed archive.

Two Parquet stores in the shared folder. ``payloads`` holds the bytes of every
distinct payload once, under its SHA-256; ``headers`` holds the exact header
bytes of every record with the digest it points to. A digest is verified twice:
payloads are grouped by digest *and* bytes when stored (two contents under one
digest fail the job), and the digest is computed anew from the bytes that the
join brings back. Original records are rebuilt by joining the stores: header
block + payload + CRLF CRLF, byte for byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, table

#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 100
#: A fixed capture date keeps the archive reproducible; callers pass their own.
DATE = "2024-01-01T00:00:00Z"
_EOL = "\r\n"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def _record_uri(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE) -> Archive:
    """Write one record per row. Null body: empty payload. Null url: an empty target.

    Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, the
    one with the smallest id is the response and the others revisit it; smaller
    payloads are all responses. A null id never wins over a number; a group of
    null ids only is all responses, and rows that repeat the winning id with
    the same payload are responses too. CR and LF in a url are percent-coded,
    so that a header stays one line. An empty table gives an empty archive.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Local tasks first reduce their copies (map-side), so a hot payload crosses the network once per task.
    merged = rows.groupBy("digest", "payload").agg(F.min("page_id").alias("first_id"), F.count("*").alias("records"))
    merged.write.parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads")
    # Only the two short columns are read here, not the payloads.
    twice = stored.select("digest", "first_id").groupBy("digest").agg(F.count("*").alias("n"), F.first("first_id").alias("first_id"))
    known = twice.select(
        "digest",
        F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("different payloads share digest "), F.col("digest")))).otherwise(F.col("first_id")).alias("first_id"),
    )
    known = materialise(known, "warc-known")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes"))
    linked = slim.join(known, "digest")
    revisit = (F.col("bytes") >= MIN_REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    head = F.concat(
        F.lit("WARC/1.1" + _EOL + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(_EOL + "WARC-Record-ID: "), _record_uri(F.col("page_id")),
        F.lit(_EOL + "WARC-Target-URI: "), F.col("url"),
        F.lit(_EOL + f"WARC-Date: {date}" + _EOL + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(_EOL + "WARC-Refers-To: "), _record_uri(F.col("first_id")),
            F.lit(_EOL + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(F.lit("")),
        F.lit(_EOL + "Content-Type: text/html" + _EOL + "Content-Length: "), F.col("bytes").cast("string"),
        F.lit(_EOL + _EOL),
    )
    linked.select("page_id", "digest", head.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    return Archive(f"{path}/headers", f"{path}/payloads")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, header, payload, record: the original record of every page, rebuilt by a join on the digest. A payload whose bytes no longer give their digest fails the job."""
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads).select("digest", "payload")
    sound = payloads.select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"),
        "payload",
    )
    return headers.join(sound, "digest").select(
        "page_id", "header", "payload",
        F.concat("header", "payload", F.lit(_EOL + _EOL).cast("binary")).alias("record"),
    )


def parse_records(records: DataFrame) -> DataFrame:
    """The fields of rebuilt records, read from their own bytes. The header ends at the first empty line and the payload follows it."""
    text = F.decode(F.col("header"), "UTF-8")
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ?([^\r\n]*)", 1)
    rows = records.select("page_id", "payload", text.alias("head"))
    refers = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return rows.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest").alias("stated_digest"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def export_warc(spark: SparkSession, archive: Archive, path: str, compression: str = "gzip") -> str:
    """Write the rebuilt records as .warc files (one gzip member per file by default), for other tools. Payloads must be UTF-8 text."""
    rows = read_archive(spark, archive).select(F.concat(F.decode("header", "UTF-8"), F.decode("payload", "UTF-8")).alias("value"))
    rows.write.option("compression", compression).option("lineSep", _EOL + _EOL).text(path)
    return path


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """url, header, payload of every record in the .warc(.gz) files under path. A file is one row of the scan, so files should stay below the binary limit of 2 GB."""
    import gzip

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, out = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end]
                    size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":", 1)[1])
                    target = next((x[16:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"warc-target-uri:")), b"")
                    out.append((target.decode(), head, data[end : end + size]))
                    at = end + size + 4
                yield pd.DataFrame(out, columns=["url", "header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "url string, header binary, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"))
    return parse_records(read_archive(spark, archive)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
