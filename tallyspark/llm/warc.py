"""Content-addressed WARC archive.

Payload bytes are stored once, compressed, under a SHA-256 digest that is verified when they are read; the exact header
of every record is stored apart. Joining the two on the digest gives the original records again, byte for byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import beside, shared_dir, stored

CRLF = "\r\n"

#: URLs that stand in a header as they are, and the signs that an encoded one keeps.
PLAIN = r"^[\x21-\x7E]*$"
RESERVED = {":": "%3A", "/": "%2F", "?": "%3F", "#": "%23", "=": "%3D", "&": "%26", "@": "%40", ",": "%2C", ";": "%3B"}


@dataclass
class Archive:
    """headers: one row per record (header bytes, digest of its payload, whether no other page has that, part); payloads: one
    row per digest."""

    headers: DataFrame
    payloads: DataFrame


@F.pandas_udf(BinaryType())
def squeezed(payload: pd.Series) -> pd.Series:
    """Zstandard frames; a column's frames hold their content's size."""
    coder = zstandard.ZstdCompressor(level=3)
    return payload.map(coder.compress, na_action="ignore")


@F.pandas_udf(BinaryType())
def unsqueezed(frame: pd.Series) -> pd.Series:
    coder = zstandard.ZstdDecompressor()
    return frame.map(coder.decompress, na_action="ignore")


def record_header(kind: Column, page_id: Column, url: Column, sha1: Column, length: Column, target: Column) -> Column:
    """The bytes of a record before its payload. A revisit carries no payload and names the record that does.

    A URL of printable ASCII stands as it is; any other is percent-encoded, and a header line says so. Without a URL
    there is no such line.
    """
    plain = url.rlike(PLAIN)
    encoded = F.url_encode(url)
    for sign, code in RESERVED.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    revisit = kind == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(length)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.when(plain, url).otherwise(F.replace(encoded, F.lit("+"), F.lit("%20")))),
        F.when(~plain, F.lit("WARC-Target-URI-Encoding: percent")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), target.cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http).cast("binary")


def write_archive(pages: DataFrame, revisit_from: int = 1000) -> Archive:
    """Write one record per row of `pages` (page_id, url, html); a null html is an empty payload.

    Of equal payloads of `revisit_from` bytes or more, the one with the largest page_id is a response and the others
    revisit it; smaller ones are all responses. Rows that repeat the largest page_id with the same payload are all
    responses; a null page_id is the smallest. Columns besides the three are ignored, and an empty table gives empty
    archive tables. Only the digest and the largest page_id of each payload are gathered by payload, in partial
    aggregates; a payload's facts then go to each part of the pages that has it (pages that were read together), and
    pages stay dealt over the parts, so a payload that a third of the pages share makes no hot task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("digest"))
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("sha1"), F.spark_partition_id().alias("part"))
    facts = stored(facts, "warc-facts")
    best = facts.groupBy("digest").agg(F.max("page_id").alias("best"), (F.count("*") == 1).alias("alone"))
    facts = beside(facts, best, "digest")
    kind = F.when((F.col("length") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("best")), "revisit").otherwise("response")
    head = record_header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("length"), F.col("best"))
    headers = stored(facts.select("page_id", kind.alias("kind"), head.alias("header"), "digest", "alone", "part"), "warc-headers")
    frames = rows.select("digest", squeezed("payload").alias("frame")).groupBy("digest").agg(F.first("frame").alias("frame"), (F.count("*") == 1).alias("alone"))
    payloads = stored(frames, "warc-payloads")
    return Archive(headers, payloads)


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def records(archive: Archive) -> DataFrame:
    """Every original record again: page_id, kind, record (header, payload unless it is a revisit, two line ends).

    A payload whose bytes don't have the digest that they are stored under raises.
    """
    end = F.lit((CRLF * 2).encode())
    heads = archive.headers
    # payloads of one page meet it at once; only what several pages have goes to parts
    full, columns = heads.where("kind = 'response'"), ["page_id", "kind", "header", "digest", "frame"]
    single = full.where("alone").join(archive.payloads.where("alone").drop("alone"), "digest").select(columns)
    full = single.unionByName(beside(full.where("not alone"), archive.payloads.where("not alone").drop("alone"), "digest").select(columns))
    full = full.select("page_id", "kind", "header", "digest", unsqueezed("frame").alias("payload"))
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    full = full.select("page_id", "kind", F.concat("header", sound, end).alias("record"))
    return full.unionByName(heads.where("kind = 'revisit'").select("page_id", "kind", F.concat("header", end).alias("record")))


def read_archive(archive: Archive) -> DataFrame:
    """The records as read back: page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to, url.

    A response's figures come from the bytes of its own record; a revisit's from the response that it names. A digest
    that doesn't fit its payload raises.
    """
    parts = F.split(F.decode("record", "utf-8"), CRLF * 2, 3)
    head = F.concat(parts[0], F.lit(CRLF))
    body = F.substring(parts[2], F.lit(1), F.length(parts[2]) - 4).cast("binary")
    split = records(archive).select("page_id", head.alias("head"), body.alias("body"))
    target = field(F.col("head"), "WARC-Target-URI")
    rows = split.select(
        "page_id",
        field(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract(F.coalesce(field(F.col("head"), "WARC-Payload-Digest"), F.lit("")), "sha1:(.*)", 1).alias("said"),
        F.regexp_extract(F.coalesce(field(F.col("head"), "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("target"),
        F.when(F.col("head").contains(f"{CRLF}WARC-Target-URI: "), F.when(F.col("head").contains(f"{CRLF}WARC-Target-URI-Encoding: percent{CRLF}"), F.url_decode(target)).otherwise(F.coalesce(target, F.lit("")))).alias("url"),
        F.sha1("body").alias("found"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.spark_partition_id().alias("part"),
    )
    rows = stored(rows, "warc-read")
    sound = F.when(F.col("said") == F.col("found"), F.col("found")).otherwise(F.raise_error(F.lit("a record's digest does not match its payload")).cast("string"))
    responses = rows.where("record_type = 'response'").select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    named = responses.groupBy(F.struct(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).alias("named")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes", "found").withColumn("refers_to", F.col("target").cast("long"))
    revisits = revisits.withColumn("named", F.struct(F.col("refers_to").alias("id"), F.col("said").alias("digest")))
    resolved = beside(revisits, named, "named", how="left")
    return responses.unionByName(resolved.select("page_id", "payload_bytes", F.col("said").alias("payload_digest"), "record_type", "refers_to", "url"))


def export(archive: Archive, path: str, spark: SparkSession | None = None) -> None:
    """Write the original records as WARC bytes, one row per record, into Parquet files at `path`."""
    shared_dir(spark or archive.headers.sparkSession)
    records(archive).write.mode("overwrite").parquet(path)
