"""A scan of mail: message bodies and attachments as one table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.scalars import one_line
from veilscan.operators.detectors import DEFAULT, Registry
from veilscan.operators.scan import scan_table
from veilscan.plans.file_scan import ScanRun
from veilscan.sources.files import classify_file, extract_text
from veilscan.sources.mail import attachment_filter

_MESSAGE = ("path", "folder", "subject", "from", "date", "index")


def message_texts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, attachments): every text there is to scan, and what became of
    each attachment."""
    store, name = F.col("path"), F.col("a.name")
    held = messages.select(*_MESSAGE, F.explode("attachments").alias("a"))
    files = attachment_filter(held.withColumn("name", name)).select(
        store.alias("store"),
        *[F.col(c).alias(c) for c in _MESSAGE if c != "path"],
        name.alias("path"),
        F.col("a.size").alias("length"),
        F.col("a.content").alias("content"),
        F.col("a.error").alias("too_large"),
        F.lit(False).alias("excluded"),
        F.lit(False).alias("oversize"),
        classify_file(name).alias("kind"),
    )
    keep = ("store", *[c for c in _MESSAGE if c != "path"], "too_large")
    attachments = extract_text(files, keep=keep).select(
        F.col("store").alias("path"),
        *[c for c in _MESSAGE if c != "path"],
        F.col("path").alias("attachment"),
        F.when(F.col("too_large").isNotNull(), F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.coalesce("too_large", "error").alias("error"),
        "text",
    )
    bodies = messages.select(
        *_MESSAGE, F.lit(None).cast("string").alias("attachment"), F.col("text").cast("binary").alias("text")
    )
    read = attachments.where(F.col("status") == "scanned").select(*_MESSAGE, "attachment", "text")
    return bodies.unionByName(read), attachments


def scan_messages(
    messages: DataFrame,
    *,
    registry: Registry = DEFAULT,
    categories: Sequence[str] | None = None,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
) -> ScanRun:
    """Findings over any messages table (:data:`veilscan.schema.MESSAGES`).

    A hit in a body is located by the message's position in its folder, one in
    an attachment by the attachment's name and the line (and page) in it.
    """
    texts, attachments = message_texts(messages)
    in_attachment = F.col("attachment").isNotNull()
    found = scan_table(
        texts,
        "path",
        "text",
        keep=(*[c for c in _MESSAGE if c != "path"], "attachment"),
        registry=registry,
        categories=categories,
        min_confidence=min_confidence,
        exclude_emails=exclude_emails,
        paged=in_attachment,
    )
    findings = found.select(
        "doc_id",
        "path",
        F.when(in_attachment, F.col("attachment")).otherwise(F.col("file_name")).alias("file_name"),
        "category",
        "category_id",
        "confidence",
        F.when(in_attachment, F.col("line")).otherwise(F.col("index")).alias("line"),
        F.when(in_attachment, F.col("page")).alias("page"),
        "match",
        "context",
        "ocr",
        "folder",
        "subject",
        "from",
        "date",
        "attachment",
        "start",
        "end",
    )
    where = F.concat_ws(" › ", "path", "subject", "attachment")
    read = attachments.where(F.col("status") == "scanned").groupBy("path").agg(F.count("*").alias("attachments"))
    stores = (
        messages.groupBy("path")
        .agg(F.max("error").alias("error"))
        .join(read, "path", "left")
        .select("path", F.lit("scanned").alias("status"), "error", F.coalesce("attachments", F.lit(0)).alias("attachments"))
    )
    gaps = attachments.where(F.col("status").isin("needs_ocr", "unreadable_doc", "error")).select(
        where.alias("path"),
        F.when(F.col("status") == "error", F.lit("attachment_error")).otherwise(F.col("status")).alias("status"),
        one_line(F.col("error")).alias("error"),
        F.lit(0).cast("long").alias("attachments"),
    )
    coverage = stores.unionByName(gaps)
    return ScanRun(findings=findings, coverage=coverage.withColumn("ocr", F.lit(False)))

