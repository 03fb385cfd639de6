"""Counts, groups, coverage and scan history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.storage import materialize

# every way a file can end, in order of precedence
STATUSES = ("error", "needs_ocr", "cloud", "mail_store", "unreadable_doc", "skipped", "scanned")
GAPS = ("needs_ocr", "cloud", "mail_store", "unreadable_doc", "oversize", "error")


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per category, most frequent first."""
    return (
        findings.groupBy("category")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("category"))
    )


def _report_order(findings: DataFrame, key: Sequence[str]) -> list[str]:
    """The order of reports within a document: line and category, then position
    and whatever else tells findings apart."""
    first = [c for c in ("line", "category", "start", "match") if c in findings.columns]
    simple = [f.name for f in findings.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return [*first, *sorted(c for c in simple if c not in first and c not in key)]


def document_groups(findings: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """One row per document with everything found in it: the key, ``total``
    findings, ``categories`` with their counts, largest first, and ``findings``,
    an array of structs of the other columns in the order of reports.

    A document is one row here, so its findings have to fit into one task;
    :func:`document_pages` cuts those of larger ones into pages."""
    key = list(key)
    order = _report_order(findings, key)
    inside = [c for c in findings.columns if c not in key]
    entry = F.struct(*order, *[c for c in inside if c not in order])
    held = findings.groupBy(*key).agg(F.collect_list(entry).alias("_held"))

    def counted(found: Column) -> Column:
        def one(category: Column) -> Column:
            n = F.size(F.filter(found, lambda f: f["category"].eqNullSafe(category))).cast("long")
            return F.struct((-n).alias("neg"), category.alias("category"), n.alias("n"))

        entries = F.transform(F.array_distinct(F.transform(found, lambda f: f["category"])), one)
        return F.transform(F.array_sort(entries), lambda e: F.struct(e["category"].alias("category"), e["n"].alias("count")))

    return held.select(
        *key,
        F.size("_held").cast("long").alias("total"),
        counted(F.col("_held")).alias("categories"),
        F.transform(F.array_sort("_held"), lambda f: F.struct(*[f[c].alias(c) for c in inside])).alias("findings"),
    )


def document_totals(findings: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """One row per document: its findings counted in total and per category,
    largest first.  Findings are counted before anything is collected, so a
    group never holds more than one entry per category."""
    per_category = findings.groupBy(*key, "category").agg(F.count("*").alias("n"))
    entry = F.struct((-F.col("n")).alias("neg"), "category", "n")
    return per_category.groupBy(*key).agg(
        F.sum("n").alias("findings"),
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["category"].alias("category"), e["n"].alias("count")),
        ).alias("categories"),
    )


def document_pages(findings: DataFrame, key: Sequence[str] = ("path",), size: int = 1000) -> DataFrame:
    """Documents with their findings inside: the key, ``page`` (from 1),
    ``total`` findings and ``categories`` of the document, and ``findings``, an
    array of at most ``size`` structs of the other columns.

    Findings stand in the order of reports: by line and category, then by
    position and whatever else tells them apart.  A document with many findings
    has many pages, and no task holds more of it than a partition or a page: its
    rows lie in several partitions of a range partitioning, and their positions
    are the place in the partition plus what earlier partitions hold.
    """
    key = list(key)
    order = _report_order(findings, key)
    spark = findings.sparkSession
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a range partitioning reads its input twice, the first time for a sample: not a scan
    held = materialize(findings)
    ordered = materialize(held.repartitionByRange(parallel, *key, *order).sortWithinPartitions(*key, *order))
    inside = [c for c in ordered.columns if c not in key]
    placed = ordered.select(
        *key, F.struct(*inside).alias("_finding"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    )
    # a row for each document of a partition; a document has no more of them than there are partitions
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.groupBy(*key, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n")).select(
        *key, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    same = F.expr(" and ".join(f"p.`{c}` <=> b.`{c}`" for c in [*key, "_part"]))
    numbered = placed.alias("p").join(begun.alias("b"), same).select("p.*", (F.col("_pos") + F.col("_shift")).alias("_at"))
    pages = numbered.groupBy(*key, (F.floor(F.col("_at") / size) + 1).cast("int").alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_finding"))), lambda x: x["_finding"]).alias("findings")
    )
    totals = document_totals(ordered, key).withColumnRenamed("findings", "total")
    whole = F.expr(" and ".join(f"p.`{c}` <=> t.`{c}`" for c in key))
    return pages.alias("p").join(totals.alias("t"), whole).select(*[f"p.{c}" for c in key], "page", "total", "categories", "p.findings")


def findings_by_source(findings: DataFrame) -> DataFrame:
    """Document totals across machines: the same path exists on many hosts."""
    return document_totals(findings, ("host", "path"))


def files_with_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.countDistinct("path").alias("files_with_findings"))


def coverage_status(
    *,
    error: Column | None = None,
    needs_ocr: Column | None = None,
    cloud: Column | None = None,
    mail_store: Column | None = None,
    unreadable_doc: Column | None = None,
    skipped: Column | None = None,
) -> Column:
    """The first condition that holds names the file's status."""
    status = F.when(F.lit(False), F.lit("scanned"))
    for name, condition in zip(STATUSES, (error, needs_ocr, cloud, mail_store, unreadable_doc, skipped)):
        if condition is not None:
            status = status.when(condition, F.lit(name))
    return status.otherwise(F.lit("scanned"))


def coverage_stats(coverage: DataFrame) -> DataFrame:
    """One row of counters over ``path, status`` and, where present, ``ocr``
    and ``attachments``.  Attachments that could not be searched have rows of
    their own; an attachment that failed counts for no counter."""

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in coverage.columns else default

    def status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    scanned = F.col("status") == "scanned"
    read = F.sum(F.when(scanned, column("attachments", F.lit(0)).cast("long")))
    return coverage.agg(
        status("scanned").alias("files_scanned"),
        F.count_if(scanned & column("ocr", F.lit(False))).alias("files_ocr"),
        F.count_if(F.col("status").isin("skipped", "oversize")).alias("files_skipped"),
        status("needs_ocr").alias("files_need_ocr"),
        status("cloud").alias("files_cloud_skipped"),
        status("mail_store").alias("files_mail_skipped"),
        status("unreadable_doc").alias("files_unreadable_docs"),
        status("error").alias("files_errored"),
        F.coalesce(read, F.lit(0)).alias("attachments_scanned"),
    )


def coverage_lists(coverage: DataFrame) -> DataFrame:
    """What was not (or only partly) searched, as sorted ``(gap, entry)`` rows;
    a mailbox is listed once, whatever the number of its files."""
    from veilscan.functions.scalars import one_line
    from veilscan.sources.mail import mail_display_path

    error = F.col("error") if "error" in coverage.columns else F.lit(None).cast("string")
    status, path = F.col("status"), F.col("path")
    partly = (status == "scanned") & error.isNotNull()
    failed = status.isin("error", "attachment_error")
    rows = coverage.where(status.isin(*GAPS, "attachment_error") | partly).select(
        F.when(failed | partly, F.lit("error")).otherwise(status).alias("gap"),
        F.when(status == "mail_store", mail_display_path(path))
        .when(partly, F.concat(path, F.lit(": partially read: "), one_line(error)))
        .when(failed, F.concat_ws(": ", path, one_line(error)))
        .otherwise(path)
        .alias("entry"),
    )
    mail = F.col("gap") == "mail_store"
    return rows.where(~mail).unionByName(rows.where(mail).distinct()).orderBy("gap", "entry")


def run_summary(
    findings: DataFrame,
    coverage: DataFrame,
    *,
    roots: Sequence[str],
    duration: str,
    masked: bool = True,
    mail_roots: Sequence[str] = (),
) -> DataFrame:
    """One row of totals for a run."""
    total = findings.agg(F.count("*").alias("findings")).scalar()
    return coverage_stats(coverage).select(
        F.array(*[F.lit(r) for r in roots]).cast("array<string>").alias("roots"),
        F.lit(duration).alias("duration"),
        F.lit(masked).alias("masked"),
        total.alias("findings"),
        "*",
        (F.array(*[F.lit(r) for r in mail_roots]) if mail_roots else F.lit(None).cast("array<string>")).alias(
            "mail_roots"
        ),
    )


def last_scan(events: DataFrame) -> DataFrame:
    """The newest summary event of every host (map-side combined)."""
    payload = [c for c in events.columns if c not in ("host", "event")]
    newest = F.max_by(F.struct(*payload), F.col("timestamp"))
    return (
        events.where(F.col("event") == "scan_summary")
        .groupBy("host")
        .agg(newest.alias("s"))
        .select("host", *[F.col(f"s.{c}").alias(c) for c in payload])
    )


def stale_scans(events: DataFrame, now: Column, days: int = 9) -> DataFrame:
    """Hosts whose newest scan is more than ``days`` old."""
    from veilscan.functions.scalars import rough_age

    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.col("timestamp"))
    return (
        last_scan(events)
        .where(seconds > days * 86400)
        .withColumn("age", rough_age(seconds))
    )


def silent_hosts(hosts: DataFrame, events: DataFrame, now: Column, days: int = 9) -> DataFrame:
    """Known hosts without any recent summary: their schedule is broken."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.col("timestamp"))
    recent = (
        events.where((F.col("event") == "scan_summary") & (seconds <= days * 86400))
        .select("host")
        .distinct()
    )
    return hosts.join(recent, "host", "left_anti")


def document_rank(findings: DataFrame, key: str = "path") -> DataFrame:
    """Documents numbered in path order, the order in which reports group them.

    A window without partitions would sort everything in one task.  Here the
    distinct paths are range-partitioned and sorted once; a path's rank is its
    place in its partition plus the sizes of the partitions before it.
    """
    spark = findings.sparkSession
    paths = findings.select(key).distinct()
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = materialize(paths.repartitionByRange(parallel, key).sortWithinPartitions(key)).select(
        key,
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"),
    )
    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return ordered.join(F.broadcast(offsets), "part").select(
        key, (F.col("base") + F.col("pos") + 1).alias("document_rank")
    )


def sort_findings(findings: DataFrame) -> DataFrame:
    """Path, line, category; then position, so the order is total."""
    ties = [c for c in ("start", "match") if c in findings.columns]
    return findings.orderBy("path", "line", "category", *ties)


def top_gaps(paths: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` unsearched documents, each with how many more there are."""
    total = paths.agg(F.count("*")).scalar()
    return (
        paths.orderBy("path")
        .limit(n)
        .select("path", F.greatest(total - n, F.lit(0)).alias("more"))
    )


def sort_history(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("generated_at"))
