"""Content-addressed WARC archive.

Payload bytes are stored once by their SHA-256 and checked against it when read. The exact header block of each record
is a row of its own table. Of records with equal payloads of at least 1000 bytes one is the response and the others
revisit it; smaller payloads are always responses, but are still stored once. Original records come back through a
join of headers and payloads.

Nulls: a null html is an empty payload; a null url gives a record without a target URI. Pages without an id have
records too, never revisit one another's place before pages with ids, and have a null page_id. Rows that repeat a
page_id and its payload are a record each and the same kind. A payload of any length is one value of one row. An empty
table has an archive of no records; other columns change nothing.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payload bytes from which on equal records revisit.
REVISIT_BYTES = 1000
#: Date of all records of an archive, unless the pages have one.
CRAWL_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    """Folders of Parquet: payloads (digest, payload) and headers (page_id, digest, header)."""

    payloads: str
    headers: str


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks cannot stand in a value and become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", " "), F.lit(CRLF)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:metaloom:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = CRAWL_DATE, revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """Writes a record per page to payloads and headers in folder (a new one)."""
    source = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), shared.text_or_empty(html).cast("binary").alias("payload"))
    facts = shared.stored(
        source.select("page", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes")),
        "warc-facts",
    )
    # Stored, so that the join with it can split the pages of a payload that very many have.
    first = shared.stored(facts.groupBy("digest").agg(F.max("page").alias("first_page")), "warc-first")
    archive = Archive(f"{folder}/payloads", f"{folder}/headers")
    # The bytes come from the first page alone; that page may be there more than once.
    heads = first.withColumnRenamed("digest", "head")
    keyed = source.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    bodies = keyed.join(heads.hint("shuffle_hash"), keyed["page"].eqNullSafe(heads["first_page"]) & (keyed["digest"] == heads["head"]), "left_semi").select("digest", "payload")
    again = facts.join(heads, facts["page"].eqNullSafe(heads["first_page"]) & (facts["digest"] == heads["head"]), "left_semi").groupBy("digest").count().filter("count > 1").limit(1).count()
    (bodies.dropDuplicates(["digest"]) if again else bodies).write.parquet(archive.payloads)

    kinds = facts.join(first, "digest").withColumn("revisits", (F.col("bytes") >= revisit_bytes) & F.col("page").isNotNull() & (F.col("page") < F.col("first_page")) | (F.col("bytes") >= revisit_bytes) & F.col("page").isNull() & F.col("first_page").isNotNull())
    kind = F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(F.col("revisits"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("revisits"), _record_id(F.col("first_page")))),
        _line("X-Payload-Length", F.col("bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisits"), F.lit(0)).otherwise(F.col("bytes"))),
        F.lit(CRLF),
    )
    kinds.select(F.col("page").alias("page_id"), "digest", header.cast("binary").alias("header")).write.parquet(archive.headers)
    return archive


def read_field(header: Column, name: str) -> Column:
    """The value of a line of a header block; null if there is none."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)$", 1), F.lit(""))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records of an archive, rebuilt: page_id, header, payload (null for revisits), record (all bytes).

    A payload that is missing or whose bytes do not have its digest is an error.
    """
    headers = spark.read.schema("page_id bigint, digest binary, header binary").parquet(archive.headers)
    payloads = spark.read.schema("digest binary, payload binary").parquet(archive.payloads)
    # Revisits have no bytes of their own: only responses meet the payloads.
    revisit = read_field(F.col("header"), "WARC-Type") == "revisit"
    whole = F.col("payload").isNotNull() & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    full = headers.filter(~revisit).join(payloads, "digest", "left")
    checked = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.hex("digest"))))
    full = full.select("page_id", "header", checked.alias("payload"))
    records = full.unionByName(headers.filter(revisit).select("page_id", "header", F.lit(None).cast("binary").alias("payload")))
    end = F.lit(CRLF + CRLF).cast("binary")
    return records.withColumn("record", F.concat("header", F.coalesce("payload", F.lit("").cast("binary")), end))


def read_pages(spark: SparkSession, archive: Archive) -> DataFrame:
    """The bytes of every page, of revisits too: page_id, header, payload. What is missing or damaged is an error.

    Both sides are as stored, so that the join can split the pages of a payload that very many have.
    """
    headers = spark.read.schema("page_id bigint, digest binary, header binary").parquet(archive.headers)
    payloads = spark.read.schema("digest binary, payload binary").parquet(archive.payloads)
    whole = F.col("payload").isNotNull() & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    checked = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.hex("digest"))))
    return headers.join(payloads, "digest", "left").select("page_id", "header", checked.alias("payload"))


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = write_archive(pages, f"{shared.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    header = F.col("header")
    kind = read_field(header, "WARC-Type")
    stated = F.regexp_extract(read_field(header, "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    # A response is measured on the bytes that came back, a revisit on what its header states of the full payload.
    return read_records(spark, archive).select(
        "page_id",
        F.when(F.col("payload").isNotNull(), F.octet_length("payload").cast("bigint")).otherwise(read_field(header, "X-Payload-Length").cast("bigint")).alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(stated).alias("payload_digest"),
        kind.alias("record_type"),
        F.regexp_extract(read_field(header, "WARC-Refers-To"), r"page:(-?\d+)>", 1).cast("bigint").alias("refers_to"),
    )
