"""Masking and rendering as native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.arrays import let

REDACTED = "********"


def mask(value: Column) -> Column:
    """Hide a value but leave enough to check it against the source: an e-mail
    keeps its first byte and its domain, anything else its last four
    alphanumerics and all separators."""
    at = F.instr(value, "@")
    domain = F.substring(value, at, F.length(value))
    local = F.substring(value, F.lit(1), at - 1)
    email = F.concat(
        F.substring(value, 1, 1), F.repeat(F.lit("*"), F.octet_length(local) - 1), domain
    )
    other = F.regexp_replace(value, "[0-9A-Za-z](?=(?:[^0-9A-Za-z]*+[0-9A-Za-z]){4})", "*")
    return F.when((at > 1) & domain.contains("."), email).otherwise(other)


def mask_from(sender: Column) -> Column:
    """Mask the address of a mail sender, keep the display name."""
    opened = F.length(sender) - F.length(F.substring_index(sender, "<", -1))  # 0: no '<'
    address = F.regexp_extract(sender, "(?s)<([^<]*)>\\z", 1)
    return (
        F.when(
            (opened > 0) & sender.endswith(">"),
            F.concat(F.substring(sender, F.lit(1), opened), mask(address), F.lit(">")),
        )
        .when(sender.contains("@"), mask(sender))
        .otherwise(sender)
    )


def csv_safe(cell: Column) -> Column:
    """Keep spreadsheets from reading a cell as a formula."""
    return F.when(cell.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def _replace(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def cef_escape_header(value: Column) -> Column:
    return _replace(value, ("\\", "\\\\"), ("|", "\\|"))


def cef_escape_ext(value: Column) -> Column:
    return _replace(value, ("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r"))


def cef_unescape(value: Column) -> Column:
    """Inverse of both escapes. Between escaped backslashes every other escape
    stands alone."""
    between = F.transform(
        F.split(value, r"\\\\", -1),
        lambda part: _replace(part, ("\\=", "="), ("\\|", "|"), ("\\n", "\n"), ("\\r", "\r")),
    )
    return F.when(value.contains("\\"), F.array_join(between, "\\")).otherwise(value)


def category_slug(category: Column) -> Column:
    """Stable machine key: lowercase, every other run of characters one '-'."""
    return F.regexp_replace(F.regexp_replace(F.lower(category), "[^a-z0-9]+", "-"), "^-|-$", "")


def fold_category(category: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(category), "[^a-z0-9]+", " "))


def one_line(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(text, "[\\s\\x0B\\u0085\\p{Z}]+", " "))


def file_name(path: Column) -> Column:
    """Base name; trailing slashes do not count."""
    bare = F.regexp_replace(path, "(?<=.)/+$", "")
    return F.when(bare == "/", bare).otherwise(F.substring_index(bare, "/", -1))


def mail_date(when: Column) -> Column:
    """``yyyy-MM-dd HH:mm``; null when the message has no date."""
    return F.date_format(when, "yyyy-MM-dd HH:mm")


def cef_severity(confidence: Column) -> Column:
    return F.when(confidence == "high", F.lit(8)).when(confidence == "medium", F.lit(5)).otherwise(F.lit(3))


def syslog_priority(confidence: Column) -> Column:
    """Facility local0; warning, notice or info."""
    return (
        F.when(confidence == "high", F.lit(132))
        .when(confidence == "medium", F.lit(133))
        .otherwise(F.lit(134))
    )


def rough_age(seconds: Column) -> Column:
    """An age the way a person would say it."""
    return (
        F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
        .when(seconds < 48 * 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days")))
    )


def lacks_text_layer(text: Column) -> Column:
    """Fewer than 20 visible characters: a scan or image without text."""
    return F.length(F.regexp_replace(text, "[\\s\\x0B\\u0085\\p{Z}]", "")) < 20


def replace_all(text: Column, replacements: Column) -> Column:
    """Apply ``array<struct<value,masked>>`` to ``text`` one after the other."""
    return let(
        text,
        lambda t: F.aggregate(
            # a replacement whose value the text never held cannot apply later
            # either, unless it contains the mask character itself
            F.filter(replacements, lambda r: t.contains(r["value"]) | r["value"].contains("*")),
            t,
            lambda done, r: F.replace(done, r["value"], r["masked"]),
        ),
    )
