"""Content-addressed WARC archive: payload bytes are stored once by a verified strong digest, exact record headers apart
from them, and the original records are put together again by joins. What a reader learns of a page it parses out of those
records, byte for byte as they would stand in a WARC file.

An archive is a folder of two tables. ``payloads`` has one row per SHA-256: the bytes, and the page whose record is the
response. ``headers`` has one row per record: its WARC header block byte for byte, its HTTP header block, and the digest.
Equal payloads become one row by a map-side combined aggregate, which keeps one of them and stops the job if payloads of one
SHA-256 ever differ in SHA-1 or length. Of records with equal payloads the one with the largest page_id
is the response and the others are revisits.

Null html is an empty payload. A null page_id is never the response of pages that have one; if no page of a payload has an
id, all of them are responses. Repeated rows of the response's id are responses too. Null urls give an empty target; line
ends in a url are percent-encoded, as a header line cannot hold them. An
empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: line end, and the base32 alphabet against the digits of base 32.
END = "\r\n"
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP_HEAD = END.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def payload_facts(payload: str) -> list[Column]:
    return [F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes")]


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write the records of ``pages`` as an archive; payloads of fewer than ``min_bytes`` bytes are responses always."""
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).select("page_id", "url", "payload", *payload_facts("payload"))
    stored = (page.groupBy("sha256").agg(F.max("page_id").alias("response"), F.first("payload").alias("payload"),
                                            *(f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("sha1", "bytes")))
              .withColumn("payload", F.when((F.col("least_sha1") == F.col("most_sha1")) & (F.col("least_bytes") == F.col("most_bytes")), F.col("payload"))
                          .otherwise(F.raise_error(F.lit("one digest, two contents")).cast("binary"))).select("sha256", "response", "payload"))
    stored.write.parquet(f"{folder}/payloads")
    response = pages.sparkSession.read.parquet(f"{folder}/payloads").select("sha256", "response")
    revisits = (F.col("bytes") >= min_bytes) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(END + END))
    line = lambda name, *value: F.concat(F.lit(name + ": "), *value, F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn("response")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))).cast("string")), F.lit(END))
    (page.drop("payload").join(response, "sha256").withColumn("revisit", revisits)
     .select("page_id", "sha256", F.encode(header, "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http")).write.parquet(f"{folder}/headers"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: page_id, record (bytes as they stand in a WARC file) and payload (of revisits too)."""
    tail = F.encode(F.lit(END + END), "UTF-8")
    body = F.when(F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}"), F.lit(b"")).otherwise(F.col("payload"))
    return spark.read.parquet(f"{folder}/headers").join(spark.read.parquet(f"{folder}/payloads").select("sha256", "payload"), "sha256").select("page_id", F.concat("header", "http", body, tail).alias("record"), "payload")


def parsed(found: DataFrame, record_col: str = "record") -> DataFrame:
    """One row per record, from its bytes alone: page_id, record_type, refers_to, target_uri, payload_digest and
    payload_bytes. A response whose payload has not the digest and length that its headers state stops the job."""
    def field(head: str, name: str, value: str = "([^\r\n]*)") -> Column:
        return F.regexp_extract(head, f"\r\n{name}: {value}(?:\r\n|$)", 1)

    def number(text: Column) -> Column:
        return F.nullif(text, F.lit("")).cast("long")

    def rest(c: str, head: str, n: Column) -> Column:  # n bytes after the head and the empty line
        return F.substring(c, F.octet_length(head) + 2 * len(END) + 1, n.cast("int"))

    rows = found.select(F.col(record_col).alias("record"), F.substring_index(F.col(record_col).cast("string"), END + END, 1).alias("head"))
    rows = rows.select("head", rest("record", "head", field("head", "Content-Length")).alias("block"))
    rows = rows.select("head", "block", F.substring_index(F.col("block").cast("string"), END + END, 1).alias("http"))
    rows = rows.select("head", field("head", "WARC-Type").alias("record_type"), field("head", "WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("digest"),
                       number(field("http", "Content-Length")).alias("payload_bytes"), rest("block", "http", F.octet_length("block")).alias("body"))
    holds = (F.col("record_type") == "revisit") | ((base32(F.sha1("body")) == F.col("digest")) & (F.octet_length("body") == F.col("payload_bytes")))
    return rows.select(number(field("head", "WARC-Record-ID", "<urn:page:(-?\\d+)>")).alias("page_id"), "record_type", number(field("head", "WARC-Refers-To", "<urn:page:(-?\\d+)>")).alias("refers_to"),
                       field("head", "WARC-Target-URI").alias("target_uri"), F.when(holds, F.col("digest")).otherwise(F.raise_error(F.lit("header and payload differ")).cast("string")).alias("payload_digest"), "payload_bytes")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``parsed`` of all records of an archive, put together again from its two tables."""
    return parsed(records(spark, folder))
