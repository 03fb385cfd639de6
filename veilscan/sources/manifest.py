"""Scan settings: the JSON manifest, and what they look like to a reader."""

from __future__ import annotations

import codecs
import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.detectors import DEFAULT, Registry, parse_confidence

DEFAULT_MAX_SIZE_MB = 50
DEFAULT_MAIL_SIZE_MB = 50 * 1024

# keys that are accepted but have no meaning for a Spark job
_IGNORED = {
    "workers": int, "memory_budget_mb": int, "html": str, "json": str, "csv": str, "syslog_out": str,
    "syslog_addr": str, "syslog_format": str, "quiet": bool, "verbose": bool, "no_findings_log": bool,
}
_LISTS = ("paths", "excludes", "exclude_emails", "categories")


@dataclass(frozen=True)
class ScanSettings:
    paths: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    exclude_emails: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    min_confidence: str = "low"
    max_size_mb: int | None = None
    show_full: bool = False
    include_cloud: bool = False
    scan_all: bool = False
    ocr: bool = False
    mail: bool = False
    extra: dict = field(default_factory=dict)

    def size_limit_mb(self) -> int:
        """Mail stores are large, so a mail scan has its own default."""
        if self.max_size_mb is not None:
            return self.max_size_mb
        return DEFAULT_MAIL_SIZE_MB if self.mail else DEFAULT_MAX_SIZE_MB

    def checked(self, registry: Registry = DEFAULT) -> ScanSettings:
        """Canonical categories; unknown names and levels are errors."""
        parse_confidence(self.min_confidence)
        if self.include_cloud:
            raise ValueError("include_cloud: files that are not on the disk cannot be fetched")
        return replace(self, categories=tuple(registry.normalize(self.categories)))


def _decode(data: bytes) -> str:
    for mark, encoding in (
        (codecs.BOM_UTF8, "utf-8-sig"),
        (codecs.BOM_UTF16_LE, "utf-16"),
        (codecs.BOM_UTF16_BE, "utf-16"),
    ):
        if data.startswith(mark):
            return data.decode(encoding)
    return data.decode("utf-8")


def load_manifest(data: bytes | str) -> dict:
    """The settings a manifest states.  A misspelt key is an error, not a scan
    of nothing; byte order marks of Windows tools are fine."""
    text = _decode(data) if isinstance(data, bytes) else data
    stated = json.loads(text)
    if not isinstance(stated, dict):
        raise ValueError("a manifest is a JSON object")
    kinds = {f.name: f.type for f in fields(ScanSettings) if f.name != "extra"}
    for key, value in stated.items():
        if key in _IGNORED:
            expected = _IGNORED[key]
        elif key in _LISTS:
            expected = list
        elif key in kinds:
            expected = str if key == "min_confidence" else int if key == "max_size_mb" else bool
        else:
            raise ValueError(f"unknown manifest key {key!r}")
        wrong_bool = expected is int and isinstance(value, bool)
        if value is not None and (not isinstance(value, expected) or wrong_bool):
            raise ValueError(f"manifest key {key!r} must be {expected.__name__}")
        if expected is list and value and not all(isinstance(v, str) for v in value):
            raise ValueError(f"manifest key {key!r} must list strings")
    return {k: v for k, v in stated.items() if v is not None}


def merge_settings(manifest: dict, **explicit) -> ScanSettings:
    """Explicit arguments win; excludes of both sides add up; paths given
    explicitly replace the manifest's."""
    known = {f.name for f in fields(ScanSettings)} - {"extra"}
    merged = {k: v for k, v in manifest.items() if k in known and v != ""}
    for key, value in explicit.items():
        if value is None:
            continue
        if key in ("excludes", "exclude_emails"):
            merged[key] = [*value, *manifest.get(key, ())]
        elif key != "paths" or value:
            merged[key] = value
    for key in _LISTS:
        merged[key] = tuple(merged.get(key, ()))
    return ScanSettings(**merged, extra={k: v for k, v in manifest.items() if k in _IGNORED})


def params_column(settings: ScanSettings, source: str = "spark") -> Column:
    """The settings as the ``params`` struct stored with a run."""
    values = asdict(settings)

    def strings(name: str) -> Column:
        return F.array(*[F.lit(v) for v in values[name]]).cast("array<string>").alias(name)

    return F.struct(
        F.lit(source).alias("source"),
        strings("excludes"),
        strings("exclude_emails"),
        F.lit(settings.min_confidence).alias("min_confidence"),
        F.lit(settings.size_limit_mb()).cast("long").alias("max_size_mb"),
        strings("categories"),
        *[F.lit(values[n]).alias(n) for n in ("ocr", "include_cloud", "scan_all", "mail")],
        F.lit(False).alias("insights_log"),
    )


def describe_params(table: DataFrame, params: str = "params") -> DataFrame:
    """``label, value`` rows, in display order, for every row of ``table``: the
    settings of a run that make a difference to it."""
    p = F.col(params)

    def names(field: str) -> Column:
        return F.when(F.size(p[field]) > 0, F.array_join(p[field], ", ")).otherwise(F.lit("-"))

    def switch(field: str) -> Column:
        return F.when(p[field], F.lit("yes")).otherwise(F.lit("no"))

    shown = {
        "source": F.nullif(p["source"], F.lit("")),
        "categories": names("categories"),
        "lowest confidence": F.lower(p["min_confidence"]),
        "excluded": names("excludes"),
        "addresses left out": names("exclude_emails"),
        "largest file": F.concat(p["max_size_mb"].cast("string"), F.lit(" MiB")),
        "images expected to have text": switch("ocr"),
        "all folders": switch("scan_all"),
        "mail only": switch("mail"),
    }
    rows = F.array(
        *[
            F.struct(F.lit(at).alias("position"), F.lit(label).alias("label"), value.alias("value"))
            for at, (label, value) in enumerate(shown.items())
        ]
    )
    keys = [c for c in table.columns if c != params]
    return table.select(*keys, F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))
