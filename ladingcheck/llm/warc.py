"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: the headers that link and check it are columns, the block is text. write() puts records in the file
format through Spark's text writer, read() gets them back by Content-Length.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "WARC/1.1"
RECORD = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_type", "block_digest",
          "payload_digest", "refers_to_digest", "content_length", "block")
_CRLF = "\r\n"

_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _character(found: re.Match) -> str:
    ref = found.group()
    if ref[1] == "#" and len(ref) > 12:  # zeros in front, or beyond every character; int() takes no number of any length
        hexed = ref[2] in "xX"
        digits = ref[3 if hexed else 2:].rstrip(";").lstrip("0") or "0"
        ref = f"&#{'x' if hexed else ''}{digits if len(digits) < 9 else '110000' if hexed else '1114112'};"
    made = markup.unescape(ref)
    return " " + made[1:] if made.startswith("\xa0") else made


def resolved(text: str) -> str:
    """HTML's named, decimal and hexadecimal references as characters, in one pass; a no-break space becomes a blank."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def _resolve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else resolved(t) for t in batch.to_pylist()], pa.string())


_resolved = F.arrow_udf(_resolve, StringType())


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from what the record is made of, so that a task that runs again writes the same one."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One response record of each page: its HTTP message and digests of block and payload. Null html has an empty payload."""
    html, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "),
                     F.octet_length(html), F.lit(_CRLF * 2), html)
    return pages.select("page_id", uri.alias("target_uri"), html.alias("_html"), block.alias("block")).select(
        "page_id", F.lit("response").alias("record_type"), record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), _digest(F.col("block"))).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.lit("text/html").alias("payload_type"),
        _digest(F.col("block")).alias("block_digest"), _digest(F.col("_html")).alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to_digest"), F.octet_length("block").cast("long").alias("content_length"), "block")


def plain_text(html: Column) -> Column:
    """Text of a page: no comments, scripts and styles; block ends and breaks become line feeds; references are resolved once."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>", "")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/article|/section|/header|/footer|/nav|/ul|/ol|/table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[!/?a-zA-Z][^>]*>", "")
    t = _resolved(t)
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response; other record types have none.

    Both refer to the response by identifier and carry its target, date and payload digest. The metadata block is the
    source headers as warc-fields (length, types, digests, HTTP status and headers, title, number of links); the conversion block is
    the payload's plain text and may be empty. Messages without a blank line are all header: their payload is empty.
    Null blocks count as empty, repeated responses give repeated derivatives of equal identifiers, an empty table gives
    none, and columns that records do not have are not read; page_id is carried where there is one.
    """
    carried = [c for c in ("page_id",) if c in records.columns]
    block = F.coalesce("block", F.lit(""))
    end = F.instr(block, _CRLF * 2)
    head = F.when(end > 0, F.substring(block, F.lit(1), end - 1)).otherwise(block)
    body = F.when(end > 0, F.substring(block, end + 4, F.length(block))).otherwise(F.lit(""))
    source = records.where("record_type = 'response'").select(
        *carried, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_type",
        F.col("content_type").alias("_type"), F.col("content_length").alias("_length"), F.col("block_digest").alias("_digest"),
        F.col("payload_digest").alias("refers_to_digest"), head.alias("_head"), body.alias("_html"))
    title = F.regexp_extract("_html", r"(?is)<title[^>]*>(.*?)</title", 1)
    source = source.select("*", plain_text(title).alias("_title"), plain_text(F.col("_html")).alias("_plain"))
    status = F.regexp_extract("_head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    fields = [("source-content-type", F.col("_type")), ("source-content-length", F.col("_length").cast("string")),
              ("source-block-digest", F.col("_digest")), ("source-payload-digest", F.col("refers_to_digest")),
              ("http-status", status), ("http-headers", F.replace("_head", F.lit(_CRLF), F.lit(" | "))),
              ("title", F.regexp_replace("_title", r"\s+", " ")),
              ("outlinks", F.regexp_count("_html", F.lit(r"(?i)<a\b[^>]*\bhref\s*=")).cast("string"))]
    metadata = F.concat(*[v for name, x in fields for v in (F.lit(f"{name}: "), F.coalesce(x, F.lit("")), F.lit(_CRLF))])
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("_plain").alias("block"))))
    out = source.withColumn("_k", kinds)
    return out.select(
        *carried, "_k.record_type", record_id(F.col("_k.record_type"), F.col("refers_to"), _digest(F.col("_k.block"))).alias("record_id"),
        "refers_to", "target_uri", "date", "_k.content_type", "payload_type", _digest(F.col("_k.block")).alias("block_digest"),
        _digest(F.col("_k.block")).alias("payload_digest"), "refers_to_digest",
        F.octet_length("_k.block").cast("long").alias("content_length"), "_k.block")


_HEADERS = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
            ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"),
            ("WARC-Identified-Payload-Type", "payload_type"), ("WARC-Block-Digest", "block_digest"),
            ("WARC-Payload-Digest", "payload_digest"), ("X-Refers-To-Digest", "refers_to_digest"),
            ("Content-Length", "content_length")]


def write(records: DataFrame, path: str) -> None:
    """Records as files of the format under `path`, one after the other; null headers are left out."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit(_CRLF)))
             for name, c in _HEADERS]
    text = F.concat(F.lit(VERSION + _CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(_CRLF), F.coalesce("block", F.lit("")), F.lit(_CRLF))
    records.select(text.alias("value")).write.option("lineSep", _CRLF).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {name.lower(): c for name, c in _HEADERS}
    for batch in batches:
        for content in batch.column("content"):
            data, at, rows = content.as_py(), 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                row = dict.fromkeys(RECORD)
                for line in data[at:end].split(b"\r\n")[1:]:
                    name, _, value = line.decode().partition(": ")
                    if (c := names.get(name.lower())) is not None:
                        row[c] = int(value) if c == "content_length" else value
                row["block"] = data[end + 4:end + 4 + row["content_length"]].decode()
                rows.append(row)
                at = end + 4 + row["content_length"] + 4
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [(c, pa.int64() if c == "content_length" else pa.string()) for c in RECORD]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under `path`; a file is one task's, so its size is what bounds a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parsed, ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in RECORD))
