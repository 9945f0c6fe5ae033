"""Content-addressed WARC archive (operator 9).

``write_archive`` keeps two tables in one folder: ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256, and ``heads`` the exact header blocks of every record with
the digest of its payload. ``read_archive`` joins them and checks every payload against its
digest, so each record comes back byte for byte; a payload that fails the check ends the
job. Equal payloads of at least ``revisit_bytes`` are one response, that with the largest
page id, and revisits of it.

Everything is DataFrame code. Payload bytes move once, to their place in the store, after each
task has reduced its copies to one; responses and revisits are told apart on narrow rows of
ids and digests.

Defined cases: null html is an empty payload; a null url an empty target; line ends in a url
are percent-encoded in headers; a payload of any length is stored whole; rows that repeat the
response's page id and payload are responses too; a null page id never is a response while
another page has the payload; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, written

_CRLF = "\r\n"


def _head(fields: list[tuple[str, Column]], http: Column) -> Column:
    """A record's header block; fields whose value is null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(_CRLF))) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.0{_CRLF}"), F.concat_ws("", *lines), F.lit(_CRLF), http)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive ``pages`` under ``path`` (tables ``payloads`` and ``heads``)."""
    payload = F.coalesce(F.encode(pages[html_col], "UTF-8"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    narrow = written(rows.select("page_id", "url", "key", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-narrow")

    rows.groupBy("key").agg(F.max("payload").alias("payload")).write.parquet(f"{path}/payloads")

    chosen = narrow.filter(F.col("n") >= revisit_bytes).groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1").select("key", "response")
    heads = narrow.join(chosen, "key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = _head(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
        ],
        http,
    )
    heads.select(F.encode(head, "UTF-8").alias("head"), "key").write.parquet(f"{path}/heads")
    drop_written(narrow)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_type, page_id, url, refers_to, digest, head, payload, record``: each record as it was written.

    ``url`` is the target in its header: line ends percent-encoded, empty where it was null. ``payload`` is the full one for revisits too; ``record`` the record's own bytes.
    """
    heads, payloads = spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/payloads")
    whole = F.sha2("payload", 256) == F.col("key")
    checked = payloads.select("key", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("key")))).alias("payload"))
    text = F.decode("head", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1)
    joined = heads.join(checked, "key", "inner")
    kind = F.col("record_type")
    out = joined.select(
        field("WARC-Type", "(\\w+)").alias("record_type"),
        F.nullif(field("WARC-Record-ID", "<urn:page:([^\r\n]*)>"), F.lit("")).alias("page_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        F.nullif(field("WARC-Refers-To", "<urn:page:([^\r\n]*)>"), F.lit("")).alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]*)").alias("digest"),
        "head",
        "payload",
    )
    end = F.encode(F.lit(_CRLF * 2), "UTF-8")
    return out.withColumn("record", F.concat("head", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), end))
