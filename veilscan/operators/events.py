"""Scan events as JSON lines, CEF lines and syslog frames, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.scalars import (
    category_slug,
    cef_escape_ext,
    cef_escape_header,
    cef_severity,
    cef_unescape,
    file_name,
    syslog_priority,
)

NOT_SEARCHED = "Scanned/image-only document with no text layer; contents were NOT searched (needs OCR)"

SUMMARY_COUNTERS = (
    "findings",
    "files_scanned",
    "files_skipped",
    "files_need_ocr",
    "files_ocr",
    "files_cloud_skipped",
    "files_mail_skipped",
    "files_unreadable_docs",
    "files_errored",
    "attachments_scanned",
)
FINDING_FIELDS = (
    "category_id",
    "path",
    "file_name",
    "category",
    "confidence",
    "line",
    "match",
    "context",
    "ocr",
    "page",
    "folder",
    "subject",
    "from",
    "date",
    "attachment",
)


@dataclass(frozen=True)
class EventFormat:
    """Names under which events are published; a receiver's rules key on them,
    so set them to what the receiver expects."""

    tool: str = "pii-scan"
    vendor: str = "example"
    version: str = "1.0"
    event_key: str = "event"
    program: str = "pii-scan"


DEFAULT_FORMAT = EventFormat()


def _stamp(timestamp: Column) -> Column:
    """RFC 3339."""
    return F.regexp_replace(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ssXXX"), "\\+00:00$", "Z")


def _head(fmt: EventFormat, kind: str, timestamp: Column, host: Column) -> list[Column]:
    return [
        F.lit(fmt.tool).alias("tool"),
        F.lit(kind).alias("event"),
        F.lit(fmt.version).alias("version"),
        _stamp(timestamp).alias("timestamp"),
        host.alias("host"),
    ]


def _blank(column: str) -> Column:
    """Optional text fields are absent rather than empty."""
    return F.when(F.col(column) != "", F.col(column)).alias(column)


def to_events(
    findings: DataFrame,
    timestamp: Column,
    host: Column,
    *,
    masked: bool = True,
    fmt: EventFormat = DEFAULT_FORMAT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One ``finding`` event per finding; masking is the caller's step.
    ``keep`` names columns to carry along, which are no part of an event."""
    optional = {"folder", "subject", "from", "date", "attachment"}
    body = []
    for name in FINDING_FIELDS:
        if name == "category_id":
            body.append(category_slug(F.col("category")).alias(name))
        elif name in findings.columns:
            body.append(_blank(name) if name in optional else F.col(name))
    return findings.select(*_head(fmt, "finding", timestamp, host), F.lit(masked).alias("masked"), *body, *keep)


def needs_ocr_events(
    paths: DataFrame, timestamp: Column, host: Column, *, fmt: EventFormat = DEFAULT_FORMAT
) -> DataFrame:
    """One event per document that could not be searched."""
    return paths.select(
        *_head(fmt, "needs_ocr", timestamp, host), "path", file_name(F.col("path")).alias("file_name")
    )


def summary_event(
    summary: DataFrame, timestamp: Column, host: Column, *, fmt: EventFormat = DEFAULT_FORMAT
) -> DataFrame:
    """The one event that ends a run."""
    return summary.select(
        *_head(fmt, "scan_summary", timestamp, host), "roots", "duration", "masked", *SUMMARY_COUNTERS, "mail_roots"
    )


def union_events(*parts: DataFrame) -> DataFrame:
    """Findings, then gaps, then the summary, as one wide table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def event_json(events: DataFrame, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    """The event as one JSON line; null fields are left out."""
    fields = [
        F.col(c).alias(fmt.event_key if c == "event" else c) for c in events.columns if c != "value"
    ]
    return F.to_json(F.struct(*fields))


def write_events(events: DataFrame, path: str, fmt: EventFormat = DEFAULT_FORMAT) -> None:
    """Append to a log of JSON lines; what is there is never rewritten."""
    events.select(event_json(events, fmt).alias("value")).write.mode("append").text(path)


def _field(columns: list[str], name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")


def to_cef(findings: DataFrame, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    """A finding as a CEF line.  The mail fields come together, and only for
    findings that have a folder or a subject."""

    def ext(name: str) -> Column:
        return cef_escape_ext(_field(findings.columns, name))

    category = F.col("category")
    mail = F.concat(
        F.lit(" cs4Label=mailFolder cs4="), ext("folder"),
        F.lit(" cs5Label=mailSubject cs5="), ext("subject"),
        F.lit(" cs6Label=mailDate cs6="), ext("date"),
        F.lit(" suser="), ext("from"),
        F.lit(" flexString1Label=attachment flexString1="), ext("attachment"),
    )
    in_mail = (_field(findings.columns, "folder") != "") | (_field(findings.columns, "subject") != "")
    return F.concat(
        F.lit("CEF:0|"), cef_escape_header(F.lit(fmt.vendor)),
        F.lit("|"), cef_escape_header(F.lit(fmt.tool)),
        F.lit("|"), cef_escape_header(F.lit(fmt.version)),
        F.lit("|"), cef_escape_header(category_slug(category)),
        F.lit("|PII detected: "), cef_escape_header(category),
        F.lit("|"), cef_severity(F.col("confidence")).cast("string"),
        F.lit("|filePath="), ext("path"),
        F.lit(" fname="), ext("file_name"),
        F.lit(" cn1Label=lineNumber cn1="), F.col("line").cast("string"),
        F.lit(" cs1Label=category cs1="), ext("category"),
        F.lit(" cs2Label=confidence cs2="), ext("confidence"),
        F.lit(" cs3Label=match cs3="), ext("match"),
        F.when(in_mail, mail).otherwise(F.lit("")),
        F.lit(" msg="), ext("context"),
    )


def needs_ocr_cef(path: Column, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    return F.concat(
        F.lit("CEF:0|"), cef_escape_header(F.lit(fmt.vendor)),
        F.lit("|"), cef_escape_header(F.lit(fmt.tool)),
        F.lit("|"), cef_escape_header(F.lit(fmt.version)),
        F.lit("|needs-ocr|Document not searched - needs OCR|5|filePath="), cef_escape_ext(path),
        F.lit(" fname="), cef_escape_ext(file_name(path)),
        F.lit(" msg="), cef_escape_ext(F.lit(NOT_SEARCHED)),
    )


def summary_cef(summary: DataFrame, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    def n(name: str) -> Column:
        return F.col(name).cast("string")

    message = F.concat(
        F.lit("roots: "), F.array_join("roots", ", "),
        F.lit("; duration "), F.col("duration"),
        F.lit("; skipped "), n("files_skipped"),
        F.lit("; cloud-skipped "), n("files_cloud_skipped"),
        F.lit("; mail-stores-skipped "), n("files_mail_skipped"),
        F.lit("; unreadable-docs "), n("files_unreadable_docs"),
        F.lit("; unreadable "), n("files_errored"),
    )
    return F.concat(
        F.lit("CEF:0|"), cef_escape_header(F.lit(fmt.vendor)),
        F.lit("|"), cef_escape_header(F.lit(fmt.tool)),
        F.lit("|"), cef_escape_header(F.lit(fmt.version)),
        F.lit("|scan-summary|PII scan completed|3|cn1Label=findings cn1="), n("findings"),
        F.lit(" cn2Label=filesScanned cn2="), n("files_scanned"),
        F.lit(" cn3Label=filesNeedOcr cn3="), n("files_need_ocr"),
        F.lit(" msg="), cef_escape_ext(message),
    )


def syslog_header(timestamp: Column, host: Column, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    """``Jul 15 14:28:47 host program: `` - what a log file carries."""
    day = F.lpad(F.dayofmonth(timestamp).cast("string"), 2, " ")
    return F.concat(
        F.date_format(timestamp, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(timestamp, "HH:mm:ss"),
        F.lit(" "), host, F.lit(f" {fmt.program}: "),
    )


def syslog_frame(
    payload: Column, confidence: Column, timestamp: Column, host: Column, fmt: EventFormat = DEFAULT_FORMAT
) -> Column:
    """The header with a priority in front, for network transport only."""
    return F.concat(
        F.lit("<"), syslog_priority(confidence).cast("string"), F.lit(">"),
        syslog_header(timestamp, host, fmt), payload,
    )


_PART = r"(?:[^|\\]|\\.)*+"
_HEAD = rf"(?s)CEF:0((?:\|{_PART}){{5}}\|\d+)\|"
# a value ends before the next `` name=``; a '=' inside it is always escaped
_PAIR = r"(?s)(?:\A| )([A-Za-z0-9]+)=((?:[^\\= ]|\\.| (?![A-Za-z0-9]+=))*+)"


# a payload begins its line or stands behind a syslog header
_JSON = r'\A(?:[^{]*: )?\{"'


def parse_cef(lines: DataFrame, value: str = "value", fmt: EventFormat = DEFAULT_FORMAT) -> DataFrame:
    """CEF lines, with or without a syslog header, as event columns.

    Four shapes: mail finding, finding, needs-ocr and summary.  JSON payloads
    are read as well, wrapped in a header or bare, with every field they have.
    A CEF line of no known shape has no ``event``.  The header and the extension
    are searched once each; of a key that is repeated the first value counts.
    """
    from veilscan.sources.eventlog import event_fields, parsed_event

    line = F.col(value)
    json_at, cef_at = F.instr(line, '{"'), F.instr(line, "CEF:0|")
    # the text of either may hold the beginning of the other
    in_json = line.rlike(_JSON) & ((cef_at == 0) | (json_at < cef_at))
    cef = F.when(~in_json, line)
    cut = lines.where((cef_at > 0) | in_json).select(
        "*",
        F.when(in_json, parsed_event(F.substring(line, json_at, F.length(line)), fmt)).alias("_json"),
        F.regexp_extract_all(F.regexp_extract(cef, _HEAD, 1), F.lit(rf"(?s)\|({_PART})"), 1).alias("_head"),
        F.regexp_extract(cef, rf"{_HEAD}(.*)\z", 2).alias("_ext"),
    )
    pairs = cut.select(
        *lines.columns,
        "_json",
        F.transform("_head", cef_unescape).alias("_head"),
        F.regexp_extract_all("_ext", F.lit(_PAIR), 1).alias("_keys"),
        F.transform(F.regexp_extract_all("_ext", F.lit(_PAIR), 2), cef_unescape).alias("_values"),
    )
    signature = F.get("_head", F.lit(3))
    kind = (
        F.when(signature == "needs-ocr", F.lit("needs_ocr"))
        .when(signature == "scan-summary", F.lit("scan_summary"))
        .when(F.get("_head", F.lit(4)).startswith("PII detected: "), F.lit("finding"))
    )
    parsed = pairs.withColumn("_event", kind)

    def of(key: str, event: str | None = None) -> Column:
        found = F.get("_values", F.array_position("_keys", key).cast("int") - 1)
        return found if event is None else F.when(F.col("_event") == event, found)

    in_cef = {
        "tool": F.get("_head", F.lit(1)),
        "version": F.get("_head", F.lit(2)),
        "event": F.col("_event"),
        "category_id": F.when(F.col("_event") == "finding", signature),
        "severity": F.get("_head", F.lit(5)).cast("int"),
        "path": of("filePath"),
        "file_name": of("fname"),
        "line": of("cn1", "finding").cast("int"),
        "category": of("cs1", "finding"),
        "confidence": of("cs2", "finding"),
        "match": of("cs3", "finding"),
        "folder": of("cs4", "finding"),
        "subject": of("cs5", "finding"),
        "date": of("cs6", "finding"),
        "from": of("suser", "finding"),
        "attachment": of("flexString1", "finding"),
        "findings": of("cn1", "scan_summary").cast("long"),
        "files_scanned": of("cn2", "scan_summary").cast("long"),
        "files_need_ocr": of("cn3", "scan_summary").cast("long"),
        "context": of("msg"),
    }
    read = event_fields("_json", fmt)
    names = dict.fromkeys([*in_cef, *read])
    return parsed.select(
        *lines.columns,
        *[F.coalesce(*[fields[name] for fields in (read, in_cef) if name in fields]).alias(name) for name in names],
    )


def parse_wrapped_json(lines: DataFrame, value: str = "value", fmt: EventFormat = DEFAULT_FORMAT) -> DataFrame:
    """JSON payloads behind a syslog header."""
    from veilscan.sources.eventlog import from_lines

    payload = lines.select(
        F.regexp_replace(F.col(value), r"^(?:<\d+>)?[^{]*?: (?=\{\x22)", "").alias("value")
    )
    return from_lines(payload.where(F.col("value").startswith('{"')), fmt)
