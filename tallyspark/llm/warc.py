"""A content-addressed web archive.

``write`` keeps two tables: payloads, each distinct byte string once under its address, and headers, the
exact header bytes of every record. The address is the SHA-256, the SHA-1 and the length together, so two
payloads share one only if two unrelated digests and the lengths agree; ``read`` computes all three again
from the stored bytes and says of each record whether they hold. ``read`` joins both tables back to whole
records; ``parsed`` takes these bytes apart again, ``to_files`` writes them as WARC/1.1 files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Shorter payloads are always stored as responses.
REVISIT_BYTES = 1_000
#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def address_of(payload: Column) -> Column:
    return F.concat_ws("-", F.sha2(payload, 256), F.sha1(payload), F.octet_length(payload).cast("string"))


def record_id(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cuts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, none for null. Line breaks in the value become spaces, as the format has no escape for them."""
    return F.when(value.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]", " "), F.lit("\r\n"))
    )


def write(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` to the archive at ``path``.

    The payload is the html in UTF-8, nothing for null. Of records with equal payloads of at least
    REVISIT_BYTES bytes the one with the largest id is the response (null ids come first; of repeated
    rows, the last) and the others are revisits of it. The date is the same for all, as pages carry none;
    a null id or url leaves its header line out. Other columns are not archived.
    """
    keyed, key = common.row_keyed(pages)
    payload = common.text_of(html_column).cast("binary")
    rows = keyed.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").cast("string").alias("url"),
        payload.alias("payload"), address_of(payload).alias("address"), record_id(F.col(f"`{key}`"), F.col(f"`{id_column}`")).alias("record"),
    )
    # partial aggregation leaves one payload of each address per task before the shuffle
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    place = F.struct(F.col("id").isNotNull().alias("has_id"), "id", "key", "record", "url")
    small = rows.drop("payload").withColumn("bytes", F.element_at(F.split("address", "-"), -1).cast("long"))
    responses = small.where(F.col("bytes") >= REVISIT_BYTES).groupBy("address").agg(F.max(place).alias("response"))
    typed = small.join(responses, "address", "left").withColumn(
        "revisit", F.col("response").isNotNull() & (F.col("response.key") != F.col("key"))
    )
    when_revisit = lambda c: F.when(F.col("revisit"), c)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(F.col("revisit"), F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", F.col("record")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.element_at(F.split("address", "-"), 2))),
        line("WARC-Profile", when_revisit(F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", when_revisit(F.col("response.record"))),
        line("WARC-Refers-To-Target-URI", when_revisit(F.col("response.url"))),
        line("X-Page-ID", F.col("id")), line("X-Refers-To-Page-ID", when_revisit(F.col("response.id"))),
        line("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.lit(len(HTTP_HEAD)) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))),
        F.lit("\r\n" + HTTP_HEAD),
    )
    typed.select("address", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def field(name: str, header: str = "header") -> Column:
    """The value of a header line, null where there is none."""
    found = F.regexp_extract(F.col(header).cast("string"), f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record: id, url, record_type, refers_to, payload_digest, payload_bytes, intact, header, payload, record.

    payload is the full one, of a revisit that of its response; record holds the exact bytes of the
    record, where a revisit has no payload. The digest and the length are computed from the stored bytes;
    intact says that they agree with the address and with the header. A record whose payload is missing
    has intact false and null bytes. An empty archive gives no rows.
    """
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("is_address", address_of(F.col("payload"))).select(
        "address", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.col("is_address") == F.col("address")).alias("same"),
    )
    both = spark.read.parquet(f"{path}/headers").join(payloads, "address", "left")
    revisit = field("WARC-Type") == "revisit"
    return both.select(
        field("X-Page-ID").cast(id_type).alias("id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast(id_type).alias("refers_to"), "payload_digest", "payload_bytes",
        F.coalesce(
            F.col("same") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest"))
            & (field("X-Payload-Length").cast("long") == F.col("payload_bytes")), F.lit(False),
        ).alias("intact"),
        "header", "payload",
        F.concat("header", F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")), F.lit(END).cast("binary")).alias("record"),
    )


def parsed(records: DataFrame, id_type: str = "long") -> DataFrame:
    """What the exact bytes of each record of ``read`` say: id, url, record_type, refers_to, payload_digest, payload_bytes, intact.

    A record is parted into header, block and end by its own Content-Length. The digest and length of a response
    are those of the payload in its block; a revisit has none, so they are those of the stored payload of its
    response. intact says that the record has the length its header names, that digest and length agree with
    the header, and that ``read`` found the stored payload intact. A record without payload is null, its
    columns too, and intact false.
    """
    head = F.substring_index(F.col("record").cast("string"), END, 1)
    parts = records.select("record", "intact", F.col("payload_digest").alias("stored_digest"), F.col("payload_bytes").alias("stored_bytes"), head.alias("head"))
    block_at = F.octet_length("head") + F.lit(len(END))
    parts = parts.withColumns({"at": block_at, "length": field("Content-Length", "head").cast("int"), "revisit": field("WARC-Type", "head") == "revisit"})
    payload = F.substr("record", F.col("at") + F.lit(len(HTTP_HEAD) + 1), F.col("length") - F.lit(len(HTTP_HEAD)))
    parts = parts.withColumn("payload", F.when(~F.col("revisit"), payload))
    own = parts.select(
        "*", F.coalesce(F.sha1("payload"), F.when(F.col("revisit"), F.col("stored_digest"))).alias("payload_digest"),
        F.coalesce(F.octet_length("payload").cast("long"), F.when(F.col("revisit"), F.col("stored_bytes"))).alias("payload_bytes"),
    )
    return own.select(
        field("X-Page-ID", "head").cast(id_type).alias("id"), field("WARC-Target-URI", "head").alias("url"),
        field("WARC-Type", "head").alias("record_type"), field("X-Refers-To-Page-ID", "head").cast(id_type).alias("refers_to"),
        "payload_digest", "payload_bytes",
        F.coalesce(
            F.col("intact") & (F.octet_length("record") == F.col("at") + F.col("length") + F.lit(len(END)))
            & (field("WARC-Payload-Digest", "head") == F.concat(F.lit("sha1:"), "payload_digest"))
            & (field("X-Payload-Length", "head").cast("long") == F.col("payload_bytes")), F.lit(False),
        ).alias("intact"),
    )


def to_files(records: DataFrame, path: str) -> None:
    """Write the records of ``read`` as WARC files, one per task. Payloads are UTF-8, so the text writer keeps their bytes."""
    whole = F.col("record").cast("string")
    records.select(F.substr(whole, F.lit(1), F.length(whole) - len(END)).alias("record")).write.option("lineSep", END).text(path)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    write(common.table(spark, folder, "pages"), path)
    return parsed(read(spark, path)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), m AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM m
"""
