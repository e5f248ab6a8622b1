"""Content-addressed WARC archive.

An archive has two Parquet tables in a folder that all executors share:

* payloads: digest (SHA-256 of the bytes) and payload, each payload once;
* headers: one row per record with the exact bytes of its WARC record header
  and the digest of its payload.

Reading checks every payload against its digest, once, and notes its length and
SHA-1; headers meet these few numbers by the digest. Only responses meet the bytes:
a response is header, payload and the two line ends; a revisit is its header and the
line ends (its payload is that of the record it refers to, and comes along on
request). Both sides of the joins are plain exchanges, which AQE splits where very
many records share a payload.

Cases: null html is an empty payload; with equal payloads of at least
min_payload bytes the smallest page_id is the response and the others revisit
it, smaller payloads are all responses; rows equal in id and payload are the
same record twice, of the same type; a null id is never the smallest unless
all ids of a payload are null; a null url is written as an empty target; an
empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from .common import cut

#: Digits of base 32 as conv() writes them and as RFC 4648 does.
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1: 160 bits are four groups of ten hexadecimal or eight base-32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _CONV, _RFC)


def _header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_END))


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write the two tables of an archive under folder (a place that all executors share)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    narrow = cut(full.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")))
    firsts = cut(narrow.groupBy("digest").agg(F.min("page_id").alias("first")))
    rec = narrow.join(firsts, "digest")
    known = (F.col("n") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + _END),
        _header("WARC-Type", F.when(known, "revisit").otherwise("response")),
        _header("WARC-Record-ID", uri(F.col("page_id"))),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(known, F.concat(_header("WARC-Refers-To", uri(F.col("first"))), _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        _header("Content-Type", "text/html; charset=utf-8"),
        _header("Content-Length", F.when(known, 0).otherwise(F.col("n")).cast("string")),
        F.lit(_END),
    )
    rec.select("page_id", "digest", F.encode(head, "UTF-8").alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")
    # the first record of each payload brings the bytes; equal rows meet in one task
    key = lambda c: F.coalesce(c, F.lit(-(2**63)).cast("long")).alias("key")
    keep = firsts.select(key(F.col("first")), "digest")
    once = full.select(key(F.col("page_id")), "digest", "payload").join(keep, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    once.select("digest", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def payload_facts(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload_bytes and sha1 (base32) of each payload; one that fails its digest is an error."""
    body = spark.read.parquet(f"{folder}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    size = F.when(good, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))).cast("long"))
    return cut(body.select("digest", size.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1")))


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, digest, header, and the facts of the payload; a missing payload is an error."""
    rec = spark.read.parquet(f"{folder}/headers").join(payload_facts(spark, folder).withColumnRenamed("digest", "known"), F.col("digest") == F.col("known"), "left")
    size = F.when(F.col("known").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("missing payload "), F.hex("digest"))).cast("long"))
    return rec.select("page_id", "digest", "header", size.alias("payload_bytes"), "sha1")


def read_archive(spark: SparkSession, folder: str, *, with_revisits: bool = False) -> DataFrame:
    """page_id, header, payload_bytes, sha1, payload and record (the exact bytes of the whole record).

    The payload of a revisit is null unless with_revisits.
    """
    heads = _heads(spark, folder).withColumn("again", field(F.col("header"), "WARC-Type") == "revisit")
    body = spark.read.parquet(f"{folder}/payloads").withColumnRenamed("digest", "known")
    meets = (F.col("digest") == F.col("known")) & (F.lit(with_revisits) | ~F.col("again"))
    rec = heads.join(body, meets, "left")
    own = F.when(F.col("again"), F.lit(b"")).otherwise(F.col("payload"))
    return rec.select("page_id", "header", "payload_bytes", "sha1", "payload", F.concat("header", own, F.lit((_END * 2).encode())).alias("record"))


def field(header: Column, name: str) -> Column:
    """A field of a record header, null where it is absent."""
    return F.nullif(F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read back from an archive, without moving payloads."""
    kind, to = field(F.col("header"), "WARC-Type"), field(F.col("header"), "WARC-Refers-To")
    return _heads(spark, folder).select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), kind.alias("record_type"), F.regexp_extract(to, r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return shared_folder(spark, "archive")
