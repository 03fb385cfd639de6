"""Masking findings together with their neighbours.

A finding's context may show the values of other findings of the same
document, so values are hidden per document, longest first: secrets become a
fixed string, matches keep enough to be checked against the source, and the
indicator categories stay readable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.arrays import bits_of, has_bit, let, slots
from veilscan.functions.scalars import REDACTED, mask, mask_from, replace_all
from veilscan.functions.storage import materialize
from veilscan.operators.detectors import PLAIN_CATEGORIES


PIECE = 4  # characters by which places in a text are matched with values
COUNTERS = 1 << 16  # counters of pieces, whatever their number
WORDS = 1 << 18  # longs of the bitmap of anchors, whatever their number
SMALL = 256  # findings and secrets of a document up to which it is grouped
SMALL_BYTES = 1 << 16  # bytes of their values up to which it is
BROADCAST = 100_000  # keys of larger documents that are sent to every executor

_ROW = "_row"


def is_plain(category: Column) -> Column:
    return category.isin(*PLAIN_CATEGORIES)


def mask_match(category: Column, match: Column) -> Column:
    return F.when(is_plain(category), match).otherwise(mask(match))


def replacements(values: Column, secrets: Column | None = None) -> Column:
    """Distinct values of one document with their masked form, longest first;
    a value that is also a secret counts as a secret."""
    hidden = (
        F.array().cast("array<string>")
        if secrets is None
        else F.filter(F.array_distinct(secrets), lambda s: s != "")
    )

    def build(secret: Column) -> Column:
        masked = F.array_except(F.array_distinct(values), secret)
        entries = F.concat(
            F.transform(secret, lambda v, i: _entry(v, i, F.lit(REDACTED))),
            F.transform(masked, lambda v, i: _entry(v, F.size(secret) + i, mask(v))),
        )
        return F.transform(F.array_sort(entries), lambda e: F.struct(e["value"], e["masked"]))

    return let(F.coalesce(hidden, F.array().cast("array<string>")), build)


def _entry(value: Column, order: Column, masked: Column) -> Column:
    return F.struct(
        (-F.octet_length(value)).alias("neg_length"),
        order.alias("ord"),
        value.alias("value"),
        masked.alias("masked"),
    )


def mask_array(findings: Column, secrets: Column | None = None) -> Column:
    """Mask the findings array of one document: map-only, safe in streams.

    ``secrets`` is ``array<struct<line,value>>``; those on a finding's line
    are hidden everywhere in the document.
    """

    def build(found: Column) -> Column:
        values = F.transform(
            F.filter(found, lambda f: ~is_plain(f["category"])), lambda f: f["match"]
        )
        on_lines = None
        if secrets is not None:
            lines = F.transform(found, lambda f: f["line"])
            on_lines = let(
                lines,
                lambda seen: F.transform(
                    F.filter(secrets, lambda s: F.array_contains(seen, s["line"])), lambda s: s["value"]
                ),
            )
        return let(
            replacements(values, on_lines),
            lambda repl: F.transform(
                found,
                lambda f: f.withField("context", replace_all(f["context"], repl)).withField(
                    "match", mask_match(f["category"], f["match"])
                ),
            ),
        )

    return let(findings, build)


def attach_secrets(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """Add ``redact``: the secret values on each finding's line.

    ``secrets`` has ``path, line, value``; lines hold few secrets (one per
    credential column), so the grouping stays small.
    """
    per_line = secrets.groupBy("path", "line").agg(F.collect_list("value").alias("redact"))
    return findings.join(per_line, ["path", "line"], "left")


def mask_findings(findings: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Mask a findings table in which the findings of one document (or of one
    mail store, however large) are spread over many rows.

    The rows of an ordinary document meet once and are masked by a list of its
    values.  A document with more than ``SMALL`` findings, or with very long
    values, is never grouped: every value is looked for by one short piece of
    it, its anchor, the piece that is rarest in the texts.  Only places of a
    text where an anchor of its document may stand leave the row, and only the
    text there, of the lengths such values have, is joined with the values by
    equality.  That finds every value a text holds and no other, and spreads by
    anchor and value rather than by document.
    """
    key = list(key)
    columns = findings.columns
    shown = [c for c in ("context", "subject") if c in columns]
    held = materialize(findings.withColumn(_ROW, F.monotonically_increasing_id()))
    large = materialize(_large_documents(held, key))
    count = large.count()
    if count:
        same = F.expr(" and ".join(f"f.`{c}` <=> l.`{c}`" for c in key))
        # a key for every SMALL findings at most, which is few as a rule
        listed = (F.broadcast(large) if count <= BROADCAST else large).alias("l")
        ordinary = held.alias("f").join(listed, same, "left_anti")
        out = _masked_by_lists(ordinary, key, shown).unionByName(
            _masked_by_anchors(held.alias("f").join(listed, same, "left_semi"), key, shown)
        )
    else:
        out = _masked_by_lists(held, key, shown)
    out = out.withColumn("match", mask_match(F.col("category"), F.col("match")))
    if "from" in columns:
        out = out.withColumn("from", mask_from(F.col("from")))
    return out.select(*[c for c in columns if c != "redact"])


def _large_documents(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keys of documents that are not to be grouped."""
    length = F.coalesce(F.octet_length("match"), F.lit(0)).cast("long")
    number = F.lit(1).cast("long")
    if "redact" in findings.columns:
        secret = F.transform("redact", lambda s: F.coalesce(F.octet_length(s), F.lit(0)).cast("long"))
        length += F.coalesce(F.aggregate(secret, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0))
        number += F.greatest(F.size("redact"), F.lit(0))
    sums = findings.groupBy(*key).agg(F.sum(number).alias("_number"), F.sum(length).alias("_length"))
    return sums.where((F.col("_number") > SMALL) | (F.col("_length") > SMALL_BYTES)).select(*key)


def _masked_by_lists(findings: DataFrame, key: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """Texts masked by all values of their document, one after the other; the
    rows of a document meet in one place."""
    columns = findings.columns
    at = _place(columns)

    def entry(kind: int, value: Column, masked: Column) -> Column:
        order = F.struct(F.lit(kind).alias("kind"), at.alias("at"))
        return F.struct((-F.octet_length(value)).alias("neg_length"), order.alias("ord"), value.alias("value"), masked.alias("masked"))

    match = F.col("match")
    hidden = ~is_plain(F.col("category")) & (match != "")
    own = F.array_compact(F.array(F.when(hidden, entry(1, match, mask(match)))))
    if "redact" in columns:
        secrets = F.transform(F.filter("redact", lambda s: s != ""), lambda s: entry(0, s, F.lit(REDACTED)))
        own = F.concat(own, F.coalesce(secrets, F.slice(own, 1, 0)))
    listed = findings.withColumn("_own", own).withColumn("_all", F.collect_list("_own").over(Window.partitionBy(*key)))

    def first_of_each(entries: Column) -> Column:
        values = F.transform(entries, lambda e: e["value"])
        return let(values, lambda seen: F.filter(entries, lambda e, i: F.array_position(seen, e["value"]) == i + 1))

    listed = listed.withColumn("_found", let(F.sort_array(F.flatten("_all")), first_of_each))
    return listed.select(
        *[_apply_all(F.col(c), F.col("_found")).alias(c) if c in shown else F.col(c) for c in columns]
    )


def _masked_by_anchors(findings: DataFrame, key: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """Texts masked by the values they hold, without grouping by document."""
    columns = findings.columns
    # as a struct keys are equal where both are null
    findings = findings.withColumn("_doc", F.struct(*key))
    key = ["_doc"]
    values = _hidden_values(findings, key)
    texts = findings.select(
        _ROW, *key, F.explode(F.array(*[F.struct(F.lit(c).alias("shown"), F.col(c).alias("text")) for c in shown])).alias("_t")
    ).select(_ROW, *key, "_t.shown", "_t.text").where(F.col("text") != "")
    hits = _values_in(texts, values, key)
    entry = F.struct((-F.octet_length("value")).alias("neg_length"), "ord", "value", "masked", "shown")
    found = hits.groupBy(_ROW).agg(F.array_sort(F.collect_set(entry)).alias("_found"))
    out = findings.join(found, _ROW, "left")
    for name in shown:
        here = F.filter(F.coalesce("_found", F.array()), lambda r: r["shown"] == name)
        out = out.withColumn(name, _apply_all(F.col(name), here))
    return out.select(*columns)


def _place(columns: Sequence[str]) -> Column:
    """Where a finding stands in its document."""
    return F.struct(*[F.col(c) for c in ("attachment", "line", "start") if c in columns])


def _hidden_values(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct values of every document (``key``) with their masked form;
    a value that is also a secret counts as a secret."""
    columns = findings.columns
    order = _place(columns)
    matched = findings.where(~is_plain(F.col("category"))).select(
        *key, F.col("match").alias("value"), F.struct(F.lit(1).alias("kind"), order.alias("at")).alias("ord")
    )
    if "redact" in columns:
        hidden = findings.select(
            *key,
            F.explode("redact").alias("value"),
            F.struct(F.lit(0).alias("kind"), order.alias("at")).alias("ord"),
        )
        matched = matched.unionByName(hidden)
    values = matched.where(F.col("value") != "").groupBy(*key, "value").agg(F.min("ord").alias("ord"))
    return values.withColumn("masked", F.when(F.col("ord.kind") == 0, F.lit(REDACTED)).otherwise(mask(F.col("value"))))


def _at_each_place(rows: DataFrame, text: str, sizes: Column) -> DataFrame:
    """A row for each piece of a text: its place ``pos`` and the ``piece``."""
    long_enough = rows.withColumn("_n", F.explode(sizes)).where(f"_n <= length({text})")
    at = long_enough.withColumn("pos", F.explode(F.expr(f"sequence(1, length({text}) - _n + 1)")))
    return at.withColumn("piece", F.expr(f"substring({text}, pos, _n)")).drop("_n")


def _values_in(texts: DataFrame, values: DataFrame, key: Sequence[str]) -> DataFrame:
    """``values`` joined with the rows of ``texts`` (of the same ``key``) whose
    text contains them: a row for each place."""
    size = F.least(F.length("value"), F.lit(PIECE))

    # the piece of each value that the fewest values have, counted by a hash
    own = _at_each_place(values, "value", F.array(size))
    hashed = own.withColumn("_slot", F.pmod(F.xxhash64("piece"), F.lit(COUNTERS)).cast("int"))
    counts = slots(hashed.groupBy(F.col("_slot").cast("long").alias("slot")).agg(F.count("*").alias("n")), COUNTERS)
    tried = hashed.withColumn("times", F.get(counts, F.col("_slot")))
    rarest = F.min(F.struct("times", "pos", "piece")).alias("_anchor")
    kept = F.first(F.struct("ord", "masked")).alias("_kept")
    anchored = materialize(
        tried.groupBy(*key, "value").agg(rarest, kept).select(
            *key, "value", F.length("value").alias("n"), "_anchor.pos", "_anchor.piece", "_kept.ord", "_kept.masked"
        )
    )
    anchors = anchored.groupBy(*key, "piece").agg(
        F.collect_set(F.struct((F.col("pos") - 1).alias("before"), "n")).alias("reach")
    )
    # which pieces may be an anchor of the document, as bits by a hash
    bitmap = bits_of(anchored.select(F.xxhash64(*key, "piece").alias("hashed")), WORDS)
    # some of 1..PIECE
    sizes = anchored.agg(F.collect_set(size)).scalar()
    places = _at_each_place(texts, "text", sizes).where(has_bit(bitmap, F.xxhash64(*key, "piece"), WORDS))
    there = (
        places.join(anchors, [*key, "piece"])
        .select(_ROW, *key, "shown", "text", "pos", F.explode("reach").alias("_r"))
        .where(F.expr("pos > _r.before and pos - _r.before + _r.n <= length(text) + 1"))
        .select(_ROW, *key, "shown", F.expr("substring(text, pos - _r.before, _r.n)").alias("value"))
    )
    return there.join(anchored.select(*key, "value", "ord", "masked"), [*key, "value"])


def _apply_all(text: Column, repl: Column) -> Column:
    return F.aggregate(repl, text, lambda done, r: F.replace(done, r["value"], r["masked"]))
