"""Filters over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.patterns import EMAIL
from veilscan.operators.detectors import CONFIDENCE_NAMES, parse_confidence


def confidence_rank(confidence: Column) -> Column:
    """low 0, medium 1, high 2 - for ordering and thresholds."""
    return (
        F.when(confidence == "high", F.lit(2)).when(confidence == "medium", F.lit(1)).otherwise(F.lit(0))
    )


def min_confidence(findings: DataFrame, level: str | int) -> DataFrame:
    """Findings at or above ``level``."""
    allowed = CONFIDENCE_NAMES[parse_confidence(level):]
    return findings.where(F.col("confidence").isin(*allowed))


def normalize_email_excludes(patterns: Sequence[str]) -> list[str]:
    """Comma-separated entries split up; every domain spelling
    (``x.com``, ``@x.com``, ``*@x.com``) becomes ``@x.com``."""
    out = []
    for entry in ",".join(patterns).lower().split(","):
        entry = entry.strip().removeprefix("*")
        if entry in ("", "@"):
            continue
        out.append(entry if "@" in entry else f"@{entry}")
    return out


def excluded_email(category: Column, value: Column, normalized: Sequence[str]) -> Column:
    """An e-mail finding whose address, or exact domain, is on the list."""
    address = F.lower(value)
    # an address has one @, so the part from it on is the whole domain
    domain = F.concat(F.lit("@"), F.substring_index(address, "@", -1))
    domains = [p for p in normalized if p.startswith("@")]
    exact = [p for p in normalized if not p.startswith("@")]
    return (category == EMAIL) & (domain.isin(domains) | address.isin(exact))


def exclude_emails(findings: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Findings without the known-benign addresses."""
    normalized = normalize_email_excludes(patterns)
    if not normalized:
        return findings
    return findings.where(~excluded_email(F.col("category"), F.col("match"), normalized))


def filter_findings(
    findings: DataFrame, text: str = "", category: str | None = None, confidence: str | None = None
) -> DataFrame:
    """The interactive report filter: ``text`` anywhere in the row or in the
    document's path (case-insensitive), one category, ``medium`` (and up) or
    ``high``."""
    out = findings
    if text:
        shown = F.lower(
            F.concat_ws(
                " ",
                *[
                    F.col(c).cast("string")
                    for c in ("path", "category", "confidence", "line", "match", "context")
                ],
            )
        )
        out = out.where(shown.contains(text.lower()))
    if category:
        out = out.where(F.col("category") == category)
    if confidence:
        out = min_confidence(out, confidence)
    return out
