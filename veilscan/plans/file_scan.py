"""A scan of files: listing, text, findings and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.storage import materialize
from veilscan.operators.detectors import DEFAULT, Registry
from veilscan.operators.masking import attach_secrets, mask_findings
from veilscan.operators.rollup import sort_findings
from veilscan.operators.scan import detect, explode_findings
from veilscan.sources.credentials import secrets_array
from veilscan.sources.files import classify_file, exclude_paths, extract_text, list_tree, too_large, with_content
from veilscan.sources.mail import is_mail_store
from veilscan.sources.manifest import ScanSettings


@dataclass(frozen=True)
class ScanRun:
    """``findings`` hold real values; :meth:`masked` is what leaves the house."""

    findings: DataFrame
    coverage: DataFrame
    secrets: DataFrame | None = None

    def masked(self) -> DataFrame:
        findings = self.findings
        if self.secrets is not None:
            findings = attach_secrets(findings, self.secrets)
        return mask_findings(findings)

    def for_output(self, settings: ScanSettings) -> DataFrame:
        return self.findings if settings.show_full else self.masked()

    def sorted(self) -> DataFrame:
        return sort_findings(self.findings)


def list_files(spark: SparkSession, settings: ScanSettings) -> DataFrame:
    """The files a scan looks at, with what is known before opening them."""
    files = exclude_paths(
        list_tree(spark, settings.paths),
        settings.excludes,
        settings.paths,
        scan_all=settings.scan_all,
        mail=settings.mail,
    )
    if settings.mail:
        # a search for mailboxes does not count everything else as skipped
        files = files.where(is_mail_store(F.col("path")))
    return files.withColumn("kind", classify_file(F.col("path"))).withColumn(
        "oversize", too_large(F.col("length"), settings.size_limit_mb())
    )


def scan_files(
    spark: SparkSession,
    settings: ScanSettings,
    *,
    registry: Registry = DEFAULT,
    ocr_text: DataFrame | None = None,
) -> ScanRun:
    """Scan files. Only files that the listing leaves in are opened: not the
    excluded, oversized and binary ones. Mailboxes are messages, not files:
    explode_messages or a messages table goes to scan_messages, so a mail scan
    is refused here."""
    settings = settings.checked(registry)
    if settings.mail:
        raise ValueError("mail: scan the messages with scan_messages(explode_messages(read_files(...)))")
    listing = list_files(spark, settings)
    opened = F.col("kind").isin("text", "sniff", "docx", "xlsx", "pptx") & ~F.col("excluded") & ~F.col("oversize")
    columns = ["path", "length", "kind", "excluded", "oversize", "error"]
    unopened = listing.where(~opened).select(*columns, F.lit(None).cast("binary").alias("content"))
    readable = with_content(listing.where(opened).select(columns))
    documents = extract_text(readable.unionByName(unopened), ocr_text=ocr_text, ocr=settings.ocr)
    scanned = F.col("status") == "scanned"
    found = detect(
        F.col("text"),
        registry.only(settings.categories),
        settings.min_confidence,
        settings.exclude_emails,
        F.col("ocr"),
    )
    # one pass over the contents; of a credential export only the secrets on
    # the lines of findings are kept
    secrets = F.when(F.size("found") > 0, secrets_array(F.col("path"), F.col("text")))
    lines = F.transform("found", lambda f: f["line"])
    results = materialize(
        documents.withColumn("found", F.when(scanned, found))
        .withColumn("lines", lines)
        .withColumn("secrets", F.filter(secrets, lambda s: F.array_contains("lines", s["line"])))
        .select("path", "status", "error", "ocr", "found", "secrets")
    )
    return ScanRun(
        findings=explode_findings(results, "path", "found", F.col("ocr")),
        coverage=results.select("path", "status", "error", "ocr"),
        secrets=results.select("path", F.explode("secrets").alias("s")).selectExpr("path", "s.line line", "s.value value"),
    )
