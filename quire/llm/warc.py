"""A content-addressed WARC archive: payload bytes once by digest, record headers apart, records rebuilt by a join.

``payloads`` (digest, payload_sha1, owner, payload) has every distinct payload once under its SHA-256; ``records`` (page_id, url, digest,
header, tail) has each record's exact header bytes. A record is header + payload + tail. Digests are verified when the archive is written
(equal SHA-256 with another SHA-1 or length is an error) and read back (the stored bytes must have the digest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import _common as C

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The day of the records; a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: Column, hex_digits: int = 40) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of 5: 5 hex digits are 4 of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, hex_digits, 5)]
    return F.translate(F.concat(*groups), digits, BASE32)


def record_id(page_id: Column) -> Column:
    """A name-based record id: the same page has the same record in every run."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def header_of(kind: Column, page_id: Column, url: Column, sha1: Column, length: Column, refers_to: Column, date: str = DATE) -> Column:
    """The WARC header block with its empty line. A revisit has no block: Content-Length 0 and a reference to its response."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")  # no line of a header may break
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(page_id)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))), F.lit(CRLF),
    ).cast("binary")


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest binary, payload_sha1 string, owner bigint, payload binary").parquet(f"{self.path}/payloads")

    @property
    def records(self) -> DataFrame:
        return self.spark.read.schema("page_id bigint, row bigint, digest binary, header binary, tail binary").parquet(f"{self.path}/records")

    def verified(self, **more: Column) -> DataFrame:
        """digest, owner and given expressions of ``payload``; stored bytes that don't have their digest raise an error."""
        good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
        stored = self.payloads.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary")))
        return stored.select("digest", "owner", *(c.alias(n) for n, c in more.items()))

    def reconstruct(self) -> DataFrame:
        """page_id, header, payload (of revisits too: the payload that they stand for), record (the exact bytes of the WARC record)."""
        joined = self.records.join(self.verified(payload=F.col("payload")), "digest")
        block = F.when(is_revisit(F.col("header")), F.lit(b"")).otherwise(F.col("payload"))
        return joined.select("page_id", "row", "header", "payload", F.concat("header", block, "tail").alias("record"))

    def catalogue(self) -> DataFrame:
        """What the archive says of each record, read back from header bytes and stored payloads.

        page_id, row, payload_bytes, payload_digest, record_type, refers_to. Payloads are verified and measured before the join, so no
        payload is shuffled. A header whose digest is not that of its payload raises an error.
        """
        measured = self.verified(payload_bytes=F.octet_length("payload").cast("bigint"), actual=base32_of_hex(F.sha1("payload")))
        header = F.col("header").cast("string")
        field = lambda name: F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        read = self.records.select("page_id", "row", "digest", field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("said"), field("WARC-Refers-To").alias("target"))
        joined = read.join(measured, "digest")
        good = (F.col("said") == F.concat(F.lit("sha1:"), "actual")) & ((F.col("record_type") == "response") | (F.col("target") == record_id(F.col("owner"))))
        digest = F.when(good, F.col("actual")).otherwise(F.raise_error(F.lit("a header contradicts its payload")).cast("string"))
        return joined.select("page_id", "row", "payload_bytes", digest.alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.col("owner")).alias("refers_to"))


def is_revisit(header: Column) -> Column:
    return F.instr(header.cast("string"), f"{CRLF}WARC-Type: revisit{CRLF}") > 0


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, least_bytes: int = 0) -> Archive:
    """Write one WARC record a row. Of equal payloads of ``least_bytes`` and more the smallest id is the response, the others revisit it.

    Null payloads count as empty; null ids come after any other. Partial aggregation keeps one row of a payload a task, so a payload that
    a third of the pages have is not a hot key. Rows that repeat an id and a payload leave one response, by row. Smaller payloads are all
    responses (and are still stored once). An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"))
    hashed = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("sha1", base32_of_hex(F.sha1("payload"))).withColumn("length", F.octet_length("payload").cast("bigint"))
    heads = C.materialize(hashed.drop("payload"), "heads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), F.col("page_id").alias("owner"), F.col("row").alias("owner_row")))
    same = (F.min("sha1") == F.max("sha1")) & (F.min("length") == F.max("length"))
    owners = C.materialize(
        heads.groupBy("digest").agg(first.alias("first"), F.when(same, F.lit(1)).otherwise(F.raise_error(F.lit("payloads with one SHA-256 digest differ")).cast("int")).alias("checked"), F.count("*").alias("n"))
        .select("digest", "first.owner", "first.owner_row", "n", "checked"), "owners",
    )
    # a payload goes with the row that owns it; only groups of two and more have rows to drop, known by id and digest
    spare = heads.join(owners.filter("n > 1").select("digest", "owner"), "digest").filter("not (page_id <=> owner)").select(F.col("page_id").alias("spare_id"), F.col("digest").alias("spare_digest"))
    match = F.col("page_id").eqNullSafe(F.col("spare_id")) & (F.col("digest") == F.col("spare_digest"))
    own = hashed.select("digest", "sha1", "page_id", "payload").join(spare, match, "left_anti")
    again = heads.groupBy(F.col("page_id").alias("spare_id"), F.col("digest").alias("spare_digest")).count().filter("count > 1").drop("count")
    if not again.isEmpty():
        again = C.materialize(again, "again")
        once = own.join(again, match, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(1)))).filter("nth = 1").drop("nth")
        own = own.join(again, match, "left_anti").unionByName(once)
    own = own.select("digest", F.col("sha1").alias("payload_sha1"), F.col("page_id").alias("owner"), "payload")
    own.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(f"{path}/payloads")
    joined = heads.join(owners.select("digest", "owner", "owner_row"), "digest")
    kind = F.when((F.col("row") != F.col("owner_row")) & (F.col("length") >= least_bytes), F.lit("revisit")).otherwise(F.lit("response"))
    header = header_of(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("length"), F.col("owner"), date)
    joined.select("page_id", "row", "digest", header.alias("header"), F.lit(CRLF * 2).cast("binary").alias("tail")).write.option("compression", "zstd").parquet(f"{path}/records")
    return Archive(spark, path)
