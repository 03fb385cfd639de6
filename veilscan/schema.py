"""Schemas of the tables that are read or written."""

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FINDINGS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("doc_id", _S), ("path", _S), ("file_name", _S), ("category", _S), ("category_id", _S),
            ("confidence", _S), ("line", _I), ("page", _I), ("match", _S), ("context", _S), ("ocr", _B),
            ("folder", _S), ("subject", _S), ("from", _S), ("date", _S), ("attachment", _S),
            ("start", _I), ("end", _I),
        )
    ]
)

EVENTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("tool", _S), ("event", _S), ("version", _S), ("timestamp", _S), ("host", _S), ("masked", _B),
            ("category_id", _S), ("path", _S), ("file_name", _S), ("category", _S), ("confidence", _S),
            ("line", _I), ("match", _S), ("context", _S), ("ocr", _B), ("page", _I), ("folder", _S),
            ("subject", _S), ("from", _S), ("date", _S), ("attachment", _S),
            ("roots", T.ArrayType(_S)), ("duration", _S), ("findings", _L), ("files_scanned", _L),
            ("files_skipped", _L), ("files_need_ocr", _L), ("files_ocr", _L), ("files_cloud_skipped", _L),
            ("files_mail_skipped", _L), ("files_unreadable_docs", _L), ("files_errored", _L),
            ("attachments_scanned", _L), ("mail_roots", T.ArrayType(_S)),
        )
    ]
)

ATTACHMENT = _struct(name=_S, size=_L, content=T.BinaryType(), error=_S)

MESSAGES = T.StructType(
    [
        T.StructField("path", _S),
        T.StructField("folder", _S),
        T.StructField("subject", _S),
        T.StructField("from", _S),
        T.StructField("date", _S),
        T.StructField("index", _I),
        T.StructField("text", _S),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
        T.StructField("error", _S),
    ]
)

PARAMS = _struct(
    source=_S,
    excludes=T.ArrayType(_S),
    exclude_emails=T.ArrayType(_S),
    min_confidence=_S,
    max_size_mb=_L,
    categories=T.ArrayType(_S),
    ocr=_B,
    include_cloud=_B,
    scan_all=_B,
    mail=_B,
    insights_log=_B,
)

REPORT_FINDING = T.StructType([f for f in FINDINGS if f.name not in ("doc_id", "category_id", "start", "end")])

REPORT_STATS = _struct(
    files_scanned=_L,
    files_ocr=_L,
    files_skipped=_L,
    files_need_ocr=_L,
    files_cloud_skipped=_L,
    files_mail_skipped=_L,
    files_unreadable_docs=_L,
    files_errored=_L,
    attachments_scanned=_L,
)

REPORT = T.StructType(
    [
        T.StructField("tool", _S),
        T.StructField("version", _S),
        T.StructField("generated_at", _S),
        T.StructField("roots", T.ArrayType(_S)),
        T.StructField("masked", _B),
        T.StructField("duration", _S),
        T.StructField("stats", REPORT_STATS),
        T.StructField("findings", T.ArrayType(REPORT_FINDING)),
        T.StructField("params", PARAMS),
    ]
)
