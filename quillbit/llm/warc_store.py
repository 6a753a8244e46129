"""A content-addressed WARC archive (operator 9).

An archive is two tables. ``payloads`` holds the bytes of every distinct payload
once, under its SHA-256; ``records`` holds one row for each record with its exact
header block and the address of its payload. Of records with equal payloads the
one with the smallest id is the ``response`` and the others are ``revisit``
records that name it. ``restore`` joins the two back into the bytes of each
record. ``read_back`` works from those bytes alone: it cuts the payload out of every
response and checks its two digests and its length, checks the head against its own
digest, and gives a revisit the payload of the response that it names, if that
carries the same digest. A changed byte anywhere makes a record unverified.

Equal payloads are reduced to one by partial aggregation before they move, so a
payload that a third of all pages share leaves each task once; joins on its
address are spread by skew handling. Payloads shorter than ``least`` bytes are
never revisited.

Cases: a null payload is empty (0 bytes); a null URL becomes an empty target; CR
and LF in a URL are percent-encoded, so headers stay well formed; rows that
repeat an id with the same payload are both responses; a null id takes part in
no group, and its record has a null ``page_id``, as has one whose id is no number; a
revisit without its response has null ``payload_bytes`` and isn't verified. Very long
payloads are stored and read whole. An empty table gives an empty archive. Extra
columns are not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import materialize
from quillbit.session import load

LEAST_BYTES = 0
#: Fixed values of the formats: the line end, and the base32 alphabet beside the
#: digits that ``conv`` writes.
CRLF = "\r\n"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


@dataclass
class Archive:
    records: DataFrame
    payloads: DataFrame


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> Archive:
    """Write the archive's tables to the shared folder."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    read = pages.select(F.col(f"`{id_col}`").alias("id"), F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"))
    addressed = read.withColumn("address", F.sha2("payload", 256))
    store = materialize(addressed.groupBy("address").agg(F.first("payload").alias("payload"), F.min("id").alias("first"), F.min_by("url", "id").alias("first_url")), "warc-payloads")
    keys = addressed.select("id", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    found = keys.join(store.select("address", "first", "first_url"), "address")
    again = (F.col("size") >= least) & (F.col("id") > F.col("first"))
    records = found.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("kind", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    body = F.lit(len(HTTP.encode())) + F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(F.col("size"))
    uri = lambda number: F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.when(
        F.col("kind") == "revisit",
        F.concat(
            line("WARC-Refers-To", uri(F.col("refers_to"))),
            line("WARC-Refers-To-Target-URI", F.col("first_url")),
            line("WARC-Refers-To-Date", F.lit(date)),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        revisit,
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", body.cast("string")),
        F.lit(CRLF),
    )
    http = F.lit(HTTP).cast("binary")
    head = header.cast("binary")
    written = materialize(records.select("id", "kind", "address", head.alias("header"), http.alias("http"), F.sha2(F.concat(head, http), 256).alias("seal")), "warc-records")
    return Archive(written, store.select("address", "payload"))


def restore(archive: Archive) -> DataFrame:
    """(id, record, address, seal): the bytes of each record as they stand in a WARC
    file, with the SHA-256 of the payload it stands for and of its head. Only responses
    fetch their payload."""
    end = F.lit(CRLF + CRLF).cast("binary")
    answers = archive.records.where("kind = 'response'").join(archive.payloads, "address")
    others = archive.records.where("kind <> 'response'")
    out = lambda rows, body: rows.select("id", F.concat("header", "http", body, end).alias("record"), "address", "seal")
    return out(answers, F.col("payload")).union(out(others, F.lit(b"")))


def read_back(restored: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of each
    record, from its bytes."""
    plain, gap = F.decode("record", "ISO-8859-1"), F.lit(CRLF + CRLF)
    blank = F.locate(CRLF + CRLF, plain)
    found = restored.select("record", "address", "seal", blank.alias("blank"), F.call_function("locate", gap, plain, blank + 4).alias("http"))
    size = F.octet_length("record")
    payload = F.substring("record", F.col("http") + 4, F.greatest(size - F.col("http") - 7, F.lit(0)))
    head = F.decode(F.substring("record", F.lit(1), F.col("blank") - 1), "UTF-8")
    cut = found.select(head.alias("head"), payload.alias("payload"), "address", (size - F.col("blank") - 3 - 4).alias("block"), ((F.sha2(F.substring("record", F.lit(1), F.col("http") + 3), 256) == F.col("seal")) & (F.substring("record", size - 3, F.lit(4)) == gap.cast("binary"))).alias("sealed"))
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    answer = F.col("record_type") == "response"
    fields = cut.select(
        number(field("WARC-Record-ID")).alias("page_id"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("size"),
        (F.col("sealed") & (F.col("block") == field("Content-Length").try_cast("bigint"))).alias("whole"),
        (F.sha2("payload", 256) == F.col("address")).alias("addressed"),
        base32_sha1(F.col("payload")).alias("computed"),
    )
    # Narrow rows, written once: no payload moves for the revisits.
    read = materialize(fields, "warc-read")
    right = F.col("whole") & F.col("addressed") & (F.col("computed") == F.col("payload_digest"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    answers = read.where(answer).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), F.coalesce(right, F.lit(False)).alias("verified"))
    named = answers.where("verified").groupBy(F.col("page_id").alias("named"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = read.where(~answer).join(named, (F.col("refers_to") == F.col("named")) & (F.col("payload_digest") == F.col("of")), "left")
    sound = F.coalesce(F.col("whole") & (F.col("size") == 0) & F.col("payload_bytes").isNotNull(), F.lit(False))
    return answers.select(columns).union(again.withColumn("verified", sound).select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return read_back(restore(build(load(spark, sf_dir, "pages"))))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(d, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > f THEN f END AS refers_to, true AS verified
FROM p
"""
