"""The functions for SQL users.

They are SQL functions, which Catalyst inlines into the query: nothing leaves
the JVM and nothing is opaque to the optimizer. The scan itself is the column
expression of ``operators.scan``, written out as SQL text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.validators import ABA_WEIGHTS

_ABA_SUM = " + ".join(
    f"CAST(substring(value, {pos + 1}, 1) AS INT) * {weight}" for pos, weight in enumerate(ABA_WEIGHTS)
)

_FUNCTIONS = {
    "pii_mask(value STRING)": r"""
        CASE WHEN instr(value, '@') > 1 AND contains(substring(value, instr(value, '@')), '.')
             THEN concat(substring(value, 1, 1),
                         repeat('*', octet_length(substring(value, 1, instr(value, '@') - 1)) - 1),
                         substring(value, instr(value, '@')))
             ELSE regexp_replace(value, r'[0-9A-Za-z](?=(?:[^0-9A-Za-z]*+[0-9A-Za-z]){4})', '*')
        END""",
    "pii_category_slug(value STRING)": """
        regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-'), '^-|-$', '')""",
    "pii_csv_safe(value STRING)": r"""
        CASE WHEN value RLIKE r'^[=+\-@\t\r]' THEN concat("'", value) ELSE value END""",
}
_BOOLEAN = {
    "pii_luhn(value STRING)": "luhn_check(value)",
    "pii_aba(value STRING)": f"value RLIKE '^[0-9]{{9}}$' AND ({_ABA_SUM}) > 0 AND ({_ABA_SUM}) % 10 = 0",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for kind, functions in (("STRING", _FUNCTIONS), ("BOOLEAN", _BOOLEAN)):
        for signature, body in functions.items():
            name, arguments = signature.split("(", 1)
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({arguments} RETURNS {kind} RETURN {body}")
            names.append(name)
    return names


#: What a column prints: strings, words before a parenthesis, anything else.
_TOKEN = re.compile(r"'(?:\\.|[^'\\])*'|[^\s(),\[\]']+(?=\()|.", re.S)
#: Words before a parenthesis that are syntax rather than names of functions.
_SYNTAX = {"CAST", "struct"}


def sql_text(column: Column) -> str:
    """A column of built-in functions as text that ``spark.sql`` reads.

    A column prints as calls of functions, operators included: ``and(a, <(b,
    1))``. With the names quoted, that is SQL.
    """
    printed = str(column)[len("Column<'") : -len("'>")]
    return "".join(
        f"`{token}`" if printed[at.end() : at.end() + 1] == "(" and _is_name(token) else token
        for at in _TOKEN.finditer(printed)
        for token in [at.group()]
    )


def _is_name(token: str) -> bool:
    return token not in _SYNTAX and not re.match(r"['\s,(\[]", token)


#: Columns of a finding in ``pii_findings`` and ``pii_scan``.
_FINDING = {
    "category": "STRING", "confidence": "STRING", "line": "INT", "page": "INT", "match": "STRING",
    "context": "STRING", "start": "INT", "end": "INT",
}


def register_scan_functions(
    spark: SparkSession,
    *,
    registry=None,
    categories: Sequence[str] | None = None,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
    prefix: str = "pii",
) -> list[str]:
    """Create the scan of one text as SQL functions; returns their names.

    ``pii_findings(text)`` gives an array, ``pii_scan(text)`` a table: ::

        SELECT d.doc_id, f.* FROM documents d, LATERAL pii_scan(d.text) f
        SELECT doc_id, inline(f) FROM (SELECT doc_id, pii_findings(text) f FROM documents)

    Both are inlined, so a query with them has the plan of ``scan_table``.  To
    keep rows without findings take ``inline_outer(f)``: Spark rewrites a LEFT
    JOIN LATERAL with a table function like a plain one.  Two sets of options
    can live side by side under different prefixes.
    """
    from veilscan.operators.detectors import DEFAULT
    from veilscan.operators.scan import detect

    chosen = (registry or DEFAULT).only(categories)
    # a null text, like one that the first look rules out, has no findings
    found = sql_text(detect(F.col("text"), chosen, min_confidence, exclude_emails))
    fields = ", ".join(f"`{name}`: {kind}" for name, kind in _FINDING.items())
    columns = ", ".join(f"`{name}` {kind}" for name, kind in _FINDING.items())
    bodies = {
        f"{prefix}_findings": f"RETURNS ARRAY<STRUCT<{fields}>> RETURN {found}",
        f"{prefix}_scan": f"RETURNS TABLE({columns}) RETURN SELECT inline({found})",
    }
    for name in reversed(bodies):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    for name, body in bodies.items():
        spark.sql(f"CREATE TEMPORARY FUNCTION {name}(text STRING) {body}")
    return list(bodies)


def register_scan_view(spark: SparkSession, view: str, table: str, id_col: str, text_col: str, **options) -> str:
    """``SELECT * FROM view``: the findings of a table's text column."""
    from veilscan.operators.scan import scan_table

    scan_table(spark.table(table), id_col, text_col, **options).createOrReplaceTempView(view)
    return view
