"""Scanning streams.  Detection and masking work inside a row, so a stream of
documents needs no state: its findings leave with the micro-batch it came in."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veilscan.operators.alerts import assign_alerts
from veilscan.operators.detectors import DEFAULT, Registry
from veilscan.operators.events import (
    DEFAULT_FORMAT,
    EventFormat,
    event_json,
    needs_ocr_events,
    summary_event,
    to_events,
)
from veilscan.operators.masking import mask_array
from veilscan.operators.rollup import run_summary
from veilscan.operators.scan import scan_table
from veilscan.sources.credentials import secrets_array
from veilscan.sources.eventlog import from_lines
from veilscan.sources.reports import published
from veilscan.sources.files import local_path
from veilscan.sources.tail import read_appended

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive in ``folder``."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)
    return stream.withColumn("path", local_path(F.col("path")))


def _mask_with_secrets(found: Column) -> Column:
    """Masks a document's findings, and the secrets of a credential export on
    their lines."""
    return mask_array(found, F.col("_secrets"))


def scan_stream(
    documents: DataFrame,
    id_col: str = "path",
    text_col: str = "content",
    *,
    masked: bool = True,
    registry: Registry = DEFAULT,
    categories: Sequence[str] | None = None,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
    keep: Sequence[str] = (),
    ocr: Column | None = None,
) -> DataFrame:
    """Findings of a stream (or a table) of documents; with ``masked`` all
    findings of a document hide each other's values, and those of a ``.csv``
    (by its id) the secrets on their lines."""
    if masked:
        documents = documents.withColumn("_secrets", secrets_array(F.col(id_col).cast("string"), F.col(text_col)))
    return scan_table(
        documents,
        id_col,
        text_col,
        keep=keep,
        registry=registry,
        categories=categories,
        min_confidence=min_confidence,
        exclude_emails=exclude_emails,
        ocr=ocr,
        transform_findings=_mask_with_secrets if masked else None,
    )


def event_sink(
    findings: DataFrame,
    host: Column,
    path: str,
    checkpoint: str,
    *,
    masked: bool = True,
    fmt: EventFormat = DEFAULT_FORMAT,
    available_now: bool = False,
    registry: Registry = DEFAULT,
):
    """Append finding events to a log; event time is the time of writing.

    Every micro-batch has a folder of its own in the log.  One that is run
    again after a failure replaces its folder, so no event is logged twice.
    Findings are counted on the way, for :class:`Progress`.
    """
    counted = observed(findings, registry)
    events = to_events(counted, F.current_timestamp(), host, masked=masked, fmt=fmt)
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").text(f"{path}/stream-{source}-{batch_id:012d}")

    writer = (
        events.select(event_json(events, fmt).alias("value"))
        .writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(
    findings: DataFrame,
    coverage: DataFrame,
    host: Column,
    path: str,
    *,
    run: str,
    roots: Sequence[str],
    duration: str,
    masked: bool = True,
    fmt: EventFormat = DEFAULT_FORMAT,
) -> bool:
    """The events that end a run: one per document that was not searched, then
    exactly one summary.  A run that failed does not get here.

    ``run`` names the run in the log.  The summary is written last, as one file,
    and says that the run has ended: a call that finds it changes nothing and
    returns False; one that does not replaces what an interrupted call left.
    """
    if published(findings.sparkSession, f"{path}/finish-{run}"):
        return False
    now = F.current_timestamp()
    gaps = needs_ocr_events(coverage.where(F.col("status") == "needs_ocr").select("path"), now, host, fmt=fmt)
    totals = run_summary(findings, coverage, roots=roots, duration=duration, masked=masked)
    summary = summary_event(totals, now, host, fmt=fmt)
    _write_lines(gaps, f"{path}/finish-{run}-gaps", fmt)
    _write_lines(summary.coalesce(1), f"{path}/finish-{run}", fmt)
    return True


def _write_lines(events: DataFrame, folder: str, fmt: EventFormat) -> None:
    events.select(event_json(events, fmt).alias("value")).write.mode("overwrite").text(folder)


def tail_events(
    spark: SparkSession, path: str, fmt: EventFormat = DEFAULT_FORMAT, *, max_bytes_per_batch: int | None = None
) -> DataFrame:
    """Follow an event log, its new files and the lines appended to those it
    has, and raise alerts, event by event."""
    lines = read_appended(spark, path, max_bytes_per_batch=max_bytes_per_batch)
    return assign_alerts(from_lines(lines, fmt))


#: Name under which a stream's findings are counted.
METRICS = "pii_findings"


def observed(findings: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """``findings``, counted in total and per category of the registry while
    they pass; the counts come with every micro-batch's progress."""
    each = [F.count_if(F.col("category") == name).alias(name) for name in registry.categories()]
    return findings.observe(METRICS, F.count("*").alias("findings"), *each)


class Progress(StreamingQueryListener):
    """Calls ``report(documents, findings)`` with running totals, of all queries
    whose findings pass :func:`observed`; ``categories`` holds them by category."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report = report
        self.documents = self.findings = 0
        self.categories: Counter[str] = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        counted = event.progress.observedMetrics.get(METRICS)
        if counted is None:
            return
        by_category = counted.asDict()
        self.findings += by_category.pop("findings")
        self.categories.update({name: n for name, n in by_category.items() if n})
        self.documents += event.progress.numInputRows
        self.report(self.documents, self.findings)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
