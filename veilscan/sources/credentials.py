"""Secrets in credential exports: CSV files with a password column.

One expression of built-in functions per document: a regular expression cuts
the text into records, another cuts records into fields, and running sums of
line breaks give the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.arrays import let, running_states

MIN_SECRET_BYTES = 4

# fixed values: header names of secret columns
SECRET_NAMES = ("password", "otpauth", "totp")
SECRET_SUFFIX = "_password"

# a quoted field ends at a quote before a comma or a line end (or with the
# text); other quotes inside it are part of it
_QUOTED = r'"(?:[^"]|""|"(?!,|\r?\n|\r?\z))*+(?:"|\z)'
_FIELD = rf"(?:{_QUOTED}|[^,\n]*+)"
_RECORD = rf"(?s){_FIELD}(?:,{_FIELD})*+(?:\n|\z)"
_NEXT_FIELD = rf"(?s),({_FIELD})"
_SECRETS = "array<struct<line: int, value: string>>"


def names_secrets(path: Column, text: Column) -> Column:
    """A ``.csv`` file that somewhere holds the name of a secret column."""
    return F.lower(path).endswith(".csv") & text.cast("string").rlike("(?i)password|otpauth|totp")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _value(field: Column) -> Column:
    """What a field holds, without its quotes."""
    inner = F.regexp_replace(field, r'(?s)\A"(.*?)"?\z', "$1")
    return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _fields(record: Column) -> Column:
    line = F.regexp_replace(record, r"\r?\n\z|\r\z", "")
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_NEXT_FIELD), 1)


def _is_secret(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(_value(name), r"(?U)\A\s+|\s+\z", ""))
    return plain.isin(*SECRET_NAMES) | plain.endswith(SECRET_SUFFIX)


def _of_record(record: Column, line: Column, secret: Column) -> Column:
    """Secrets of a record: on its own line, and on the field's where that is a
    later one because earlier fields hold line breaks."""

    def build(fields: Column) -> Column:
        def of_field(field: Column, i: Column) -> Column:
            later = F.aggregate(F.slice(fields, 1, i), F.lit(0), lambda n, f: n + _breaks(f))
            return let(
                _value(field),
                lambda value: F.when(
                    F.coalesce(F.get(secret, i), F.lit(False)) & (F.octet_length(value) >= MIN_SECRET_BYTES),
                    let(
                        later,
                        lambda down: F.when(
                            down > 0,
                            F.array(
                                F.struct(line.alias("line"), value.alias("value")),
                                F.struct((line + down).alias("line"), value.alias("value")),
                            ),
                        ).otherwise(F.array(F.struct(line.alias("line"), value.alias("value")))),
                    ),
                ).otherwise(F.array().cast(_SECRETS)),
            )

        return F.flatten(F.transform(fields, of_field))

    return let(_fields(record), build)


def secrets_array(path: Column, text: Column) -> Column:
    """The secrets of a document as ``array<struct<line, value>>``; empty for
    all but ``.csv`` texts that name a secret column in their first record.
    Blank lines are no records; records may have any number of fields."""

    def of_records(records: Column) -> Column:
        lines = running_states(F.transform(records, _breaks), F.lit(1), lambda at, n: at + n)

        def placed(starts: Column) -> Column:
            rows = F.filter(
                F.transform(
                    records,
                    lambda r, i: F.struct(
                        r.alias("r"), F.when(i == 0, F.lit(1)).otherwise(F.get(starts, i - 1)).alias("line")
                    ),
                ),
                lambda x: ~x["r"].rlike(r"\A\r?\n?\z"),
            )
            return let(rows, of_rows)

        return let(lines, placed)

    def of_rows(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))["r"]

        def of_columns(secret: Column) -> Column:
            rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
            return F.when(
                F.exists(secret, lambda s: s),
                F.flatten(F.transform(rest, lambda x: _of_record(x["r"], x["line"], secret))),
            ).otherwise(F.array().cast(_SECRETS))

        return let(F.transform(_fields(F.coalesce(head, F.lit(""))), _is_secret), of_columns)

    valid = F.make_valid_utf8(text.cast("string"))
    found = let(F.regexp_extract_all(valid, F.lit(_RECORD), 0), of_records)
    return F.when(names_secrets(path, text), found).otherwise(F.array().cast(_SECRETS))


def credential_secrets(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, line, value`` of the secrets in ``.csv`` documents."""
    found = documents.select(F.col(path).alias("path"), F.explode(secrets_array(F.col(path), F.col(text))).alias("s"))
    return found.select("path", F.col("s.line").alias("line"), F.col("s.value").alias("value"))
