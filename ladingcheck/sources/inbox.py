"""Reading an inbox: mails, attachments, MIME messages, and the identities they get."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.functions.text import base_name, line_ends, media_type, strip, strip_html

_CP1252_FROM = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_CP1252_TO = "".join(bytes([b]).decode("cp1252") for b in _CP1252_FROM)
_CP1252_UNDEFINED = r"[\x81\x8D\x8F\x90\x9D]"


# --- mails ---------------------------------------------------------------------


def read_inbox(spark: SparkSession, root: str) -> DataFrame:
    """All ``inbox/email_*.json`` below a registry root, one JSON object per file."""
    raw = (
        spark.read.schema(schema.EMAIL + ", _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .json(f"{root.rstrip('/')}/inbox/email_*.json")
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(
        "email_id", F.col("from").alias("from_addr"), "subject", "body", "attachments",
        "received_at", stem.alias("file_stem"), F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


def received_at_ok(raw: Column) -> Column:
    text = strip(raw)
    return raw.isNull() | (
        text.rlike(K.ISO_UTC)
        & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    )


def email_problem(df: DataFrame) -> Column:
    """First reason an email record is refused, or NULL."""
    problem = F.lit(None).cast("string")
    if "corrupt" in df.columns:
        problem = F.when(F.col("corrupt"), "UNREADABLE_JSON")
    checks = [
        (F.col("email_id").isNull(), "MISSING_EMAIL_ID"),
        (~F.col("email_id").rlike(K.EMAIL_ID), "UNSAFE_EMAIL_ID"),
        (F.col("from_addr").isNull(), "MISSING_FROM"),
        (F.col("subject").isNull(), "MISSING_SUBJECT"),
        (F.col("body").isNull(), "MISSING_BODY"),
        (~received_at_ok(F.col("received_at")), "BAD_RECEIVED_AT"),
    ]
    if "file_stem" in df.columns:
        checks.insert(2, (F.col("email_id") != F.col("file_stem"), "IDENTITY_MISMATCH"))
    reason = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return F.coalesce(problem, reason)


def validate_emails(emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good mails, refused mails with ``problem``).

    Duplicate ids are counted with a partial aggregate, so an id that fills a
    third of the inbox is not gathered into one task.
    """
    checked = emails.withColumn("problem", email_problem(emails))
    repeated = (
        checked.groupBy("email_id").count().filter("count > 1")
        .select("email_id", F.lit(True).alias("repeated"))
    )
    checked = (
        checked.join(repeated, "email_id", "left")
        .withColumn("problem", F.coalesce("problem", F.when(F.col("repeated"), "DUPLICATE_EMAIL_ID")))
        .drop("repeated")
    )
    good = checked.filter("problem is null").drop("problem", "corrupt", "file_stem").withColumn(
        "received_at",
        F.try_to_timestamp(F.substring(strip(F.col("received_at")), 1, 19),
                           F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return good, checked.filter("problem is not null")


def pick_registry(emails: DataFrame) -> DataFrame:
    """The same id in two registries: the synthetic demo record wins."""
    demo = emails.filter(F.col("registry") == "synthetic_demo")
    other = emails.filter(F.col("registry") != "synthetic_demo")
    return demo.unionByName(other.join(demo.select("email_id").distinct(), "email_id", "left_anti"))


# --- attachments -----------------------------------------------------------------


def read_files(spark: SparkSession, root: str, registry: str) -> DataFrame:
    """Attachment bytes below a registry root: registry, path, content, size_bytes."""
    root = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .load(f"{root}/attachments")
    )
    # The folder names of the root may hold "attachments" themselves, so its whole path is cut off.
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root) + "/attachments/"
    relative = F.concat(F.lit("attachments/"), F.substring(
        F.col("path"), F.instr("path", folder) + len(folder), F.length("path")))
    return files.select(
        F.lit(registry).alias("registry"), relative.alias("path"), "content",
        F.col("length").alias("size_bytes"),
    )


def decode_text(content: Column) -> Column:
    """struct(text, encoding): strict UTF-8 (with or without mark), else strict cp1252."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    mark = "﻿"
    western = F.when(
        ~latin.rlike(_CP1252_UNDEFINED),
        F.translate(latin, "".join(map(chr, _CP1252_FROM)), _CP1252_TO))
    marked = utf8.startswith(mark)
    text = F.when(marked, F.substring(utf8, 2, 2147483647)).when(utf8.isNotNull(), utf8).otherwise(western)
    encoding = (
        F.when(utf8.isNotNull(), "utf-8-sig")  # the first codec tried accepts both forms
        .when(western.isNotNull(), "cp1252")
    )
    return F.struct(line_ends(text).alias("text"), encoding.alias("encoding"))


def detect_format(content: Column, decodable: Column) -> Column:
    """pdf, docx, xlsx, text or unsupported, by signature; the name is not consulted."""
    head = F.hex(F.substring(content, 1, 5))
    archive = F.left(head, F.lit(8)).isin("504B0304", "504B0506", "504B0708")

    def member(name: str) -> Column:
        return F.contains(content, F.lit(name.encode("ascii")))

    has_nul = F.contains(content, F.lit(b"\x00"))
    return (
        F.when(head == "255044462D", "pdf")
        .when(archive & member("word/document.xml"), "docx")
        .when(archive & member("xl/workbook.xml"), "xlsx")
        .when(archive, "unsupported")
        .when(decodable & ~has_nul, "text")
        .otherwise("unsupported")
    )


def reference_problem(path: Column) -> Column:
    """True for an attachment reference that must not be opened."""
    text = strip(path)
    return (
        F.coalesce(text, F.lit("")).eqNullSafe("")
        | text.contains("://")
        | text.startswith("/")
        | (F.substring(text, 2, 1) == ":")
        | F.array_contains(F.split(text, "/"), "..")
    )


def document_id(run_kind: Column, case_id: Column, registry: Column, path: Column,
                content_hash: Column) -> Column:
    joined = F.concat_ws("\x00", run_kind, case_id, registry, path, F.coalesce(content_hash, F.lit("")))
    return F.concat(F.lit("doc_"), F.left(F.sha2(joined.cast("binary"), 256), F.lit(20)))


def declared_sources(emails: DataFrame) -> DataFrame:
    """One row per listed attachment, in order: key, position, path, unsafe."""
    return emails.select(
        "run_kind", F.col("email_id").alias("case_id"), "registry",
        F.posexplode("attachments").alias("position", "path"),
    ).withColumns({
        "unsafe": reference_problem(F.col("path")),
        "filename": base_name(F.col("path")),
    }).withColumn("media_type", media_type(F.col("filename")))


def resolve_sources(emails: DataFrame, files: DataFrame) -> DataFrame:
    """Listed attachments joined to what is there, each with its issue if any.

    ``files`` needs registry, path, size_bytes, content_hash; any other column
    (the parsed form) is carried along. Files are joined after parsing, so
    document bytes are never shuffled. A file that very many mails list makes a
    hot join key on the narrow side only, which adaptive skew handling splits.
    """
    listed = declared_sources(emails)
    present = files.withColumnRenamed("path", "file_path").withColumnRenamed("registry", "file_registry")
    joined = listed.join(
        present,
        (listed.registry == present.file_registry)
        & (strip(listed.path) == present.file_path) & ~listed.unsafe,
        "left",
    )
    oversized = F.col("size_bytes") > K.MAX_SOURCE_BYTES
    issue = (
        F.when(F.col("unsafe"), "UNSAFE_REFERENCE")
        .when(F.col("file_path").isNull(), "MISSING_FILE")
        .when(oversized, "OVERSIZED")
    )
    # OVERSIZED is a mark only: such a file is read like any other.
    read = issue.isNull() | (issue == "OVERSIZED")
    return joined.withColumns({"issue": issue, "content_hash": F.when(read, F.col("content_hash")), "present": read}).withColumns({
        "demo_safe": F.col("registry") == "synthetic_demo",
        "document_id": document_id(F.col("run_kind"), F.col("case_id"), F.col("registry"),
                                   F.col("path"), F.col("content_hash")),
    }).drop("file_path", "file_registry", "unsafe")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "content_hash": F.sha2("content", 256),
        "size_bytes": F.octet_length("content").cast("bigint"),
    })


def verify_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Present sources with ``intact``: the bytes now still have the recorded hash."""
    now = with_hash(files).select("registry", "path", F.col("content_hash").alias("hash_now"))
    return (
        sources.filter("present").join(now, ["registry", "path"], "left")
        .withColumn("intact", F.col("hash_now").eqNullSafe(F.col("content_hash")))
    )


def snapshot(emails: DataFrame, sources: DataFrame) -> DataFrame:
    """One frozen input per case, with an ``input_version`` over mail and attachments.

    The attachment list of a case is as long as the list in its own mail record.
    """
    per_case = sources.groupBy(*schema.KEY).agg(
        F.sort_array(F.collect_list(F.struct(
            "position", "path", "document_id", "content_hash", "size_bytes", "present", "issue",
        ))).alias("sources")
    )
    base = emails.withColumn("case_id", F.col("email_id")).join(per_case, schema.KEY, "left")
    canonical = F.to_json(F.struct(
        F.transform(
            F.coalesce("sources", F.array()),
            lambda s: F.struct(s["content_hash"].alias("hash"), s["issue"].alias("issue"),
                               s["path"].alias("path"), s["present"].alias("present"),
                               s["size_bytes"].alias("size")),
        ).alias("attachments"),
        "body", "email_id", F.col("from_addr").alias("from"), "received_at", "subject",
    ), {"ignoreNullFields": "false"})
    return base.withColumns({
        "input_version": F.concat(F.lit("iv1_"), F.left(F.sha2(canonical.cast("binary"), 256), F.lit(24))),
        "demo_safe": F.col("registry") == "synthetic_demo",
        "source_count": F.coalesce(F.size("sources"), F.lit(0)),
    })


# --- MIME messages -----------------------------------------------------------------

MIME_SCHEMA = (
    "path string, from_addr string, subject string, sent_at timestamp, text_body string, "
    "html_body string, attachments array<struct<filename:string,content:binary>>"
)


def _mime_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import email
    import email.header
    import email.utils
    from datetime import timezone

    def header(value) -> str:
        parts = []
        for chunk, charset in email.header.decode_header(value) if value else ():
            if isinstance(chunk, bytes):
                try:
                    chunk = chunk.decode(charset or "utf-8", errors="replace")
                except LookupError:
                    chunk = chunk.decode("utf-8", errors="replace")
            parts.append(chunk)
        return "".join(parts).strip()

    def text_of(part) -> str:
        data = part.get_payload(decode=True) or b""
        try:
            return data.decode(part.get_content_charset() or "utf-8", errors="replace")
        except LookupError:
            return data.decode("utf-8", errors="replace")

    def sent(value):
        try:
            moment = email.utils.parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return None
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        return moment

    def row(path: str, data: bytes) -> dict:
        message = email.message_from_bytes(data)
        single = not message.is_multipart()
        bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
        files = []
        for part in message.walk():
            if part.is_multipart():
                continue
            kind = part.get_content_type()
            name = header(part.get_filename()) if part.get_filename() and not single else ""
            disposition = str(part.get("Content-Disposition", "")).lower()
            if name:
                payload = part.get_payload(decode=True)
                if payload:
                    files.append({"filename": name, "content": payload})
            elif single:
                bodies["text/html" if kind == "text/html" else "text/plain"].append(text_of(part))
            elif kind in bodies and "attachment" not in disposition and part.get_payload(decode=True):
                bodies[kind].append(text_of(part))
        return {
            "path": path, "from_addr": header(message.get("From")),
            "subject": header(message.get("Subject")), "sent_at": sent(message.get("Date")),
            "text_body": "\n\n".join(bodies["text/plain"]) if bodies["text/plain"] else None,
            "html_body": "\n\n".join(bodies["text/html"]) if bodies["text/html"] else None,
            "attachments": files,
        }

    columns = ["path", "from_addr", "subject", "sent_at", "text_body", "html_body", "attachments"]
    for batch in batches:
        frame = pd.DataFrame([row(p, c) for p, c in zip(batch["path"], batch["content"])], columns=columns)
        frame["sent_at"] = pd.to_datetime(frame["sent_at"])
        yield frame


def mime_rows(messages: DataFrame) -> DataFrame:
    """Raw messages (path, content) to sender, subject, time, body and attachments.

    Plain text wins over HTML; tags are stripped on the JVM side. A date that
    cannot be read stays NULL.
    """
    parsed = messages.select("path", "content").mapInPandas(_mime_batches, MIME_SCHEMA)
    body = F.coalesce(strip(F.col("text_body")), strip_html(F.col("html_body")), F.lit(""))
    return parsed.withColumn("body", body).drop("text_body", "html_body")
