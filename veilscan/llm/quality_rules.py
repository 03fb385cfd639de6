"""Quality rules as a short-circuit cascade of built-in functions.

Each rule is a Boolean expression over measures of the text. Its cost and its
rate of rejections are measured on a bounded sample; the cascade then asks the
rules in the order of rejections per second, and the first that rejects is
named. The measures are part of the result and so are computed for every
document; what the order saves are comparisons. A document is kept when no rule
rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import SEPARATORS, keep, prepare

#: Rows, at most about, on which costs and rejections are measured.
SAMPLE_ROWS = 2000
_SPACE = " \\t\\n\\u000B\\u000C\\r"
_RUN = 8


def _length_without(characters: str) -> str:
    return f"char_length(translate(text, '{characters}', ''))"


#: Measures over ``text`` (never null) and the arrays of ``_with_arrays``.
MEASURES = {
    "n_words": "size(words)",
    "word_chars": _length_without(_SPACE),
    "n_symbols": f"char_length(text) - {_length_without('#*$%&|<>')}",
    "n_lines": "size(lines)",
    "n_dup_lines": "size(lines) - size(array_distinct(lines))",
    "n_letters": "char_length(regexp_replace(text, '[^\\\\p{L}]+', ''))",
    "n_repeat_words": "repeat_words",
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the measures that it names."""

    name: str
    rejects: str
    measures: tuple[str, ...]


BASE_RULES = (
    Rule("few_words", "n_words < 20", ("n_words",)),
    Rule("repeated_runs", "100 * n_repeat_words > 30 * n_words", ("n_repeat_words", "n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", ("word_chars", "n_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_symbols", "n_words")),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines", ("n_dup_lines", "n_lines")),
    Rule("letters", "2 * n_letters < word_chars", ("n_letters", "word_chars")),
)


def measured(docs: DataFrame, id_col: str, text_col: str, measures) -> DataFrame:
    """(id, measures): a null text counts as empty, and all its measures are 0."""
    names = set(measures)
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if names & {"n_words", "n_repeat_words"}:
        out = out.withColumn("words", F.filter(F.split("text", SEPARATORS), lambda w: w != ""))
    if names & {"n_lines", "n_dup_lines"}:
        out = out.withColumn("lines", F.expr(f"filter(split(text, '\\n'), line -> translate(line, '{_SPACE}', '') <> '')"))
    if "n_repeat_words" in names:
        out = _with_repeats(out)
    # a generator's columns are not replaced by their expressions, so a filter
    # on a measure does not compute it again for each of its uses
    values = F.struct(*[F.expr(f"cast({MEASURES[m]} as bigint)").alias(m) for m in measures])
    return out.select("id", F.inline(F.array(values)))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """repeat_words: words in runs of 8 that the text has twice or more. Only a
    text with equal runs pays for finding their places."""
    run = ", ".join(f"hashes[i + {j}]" for j in range(_RUN))
    return (
        docs.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn(
            "runs",
            F.expr(f"if(size(words) < {_RUN}, array(), transform(sequence(0, size(words) - {_RUN}), i -> xxhash64({run})))"),
        )
        .withColumn(
            "placed",
            F.expr(
                "if(size(array_distinct(runs)) = size(runs), array(),"
                " sort_array(transform(runs, (run, place) -> struct(run, place))))"
            ),
        )
        .withColumn(
            "places",
            F.expr(
                "sort_array(transform(filter(transform(placed, (x, i) -> struct(x.place,"
                " (i > 0 and placed[i - 1].run = x.run) or (i < size(placed) - 1 and placed[i + 1].run = x.run) as again)),"
                " x -> x.again), x -> x.place))"
            ),
        )
        .withColumn(
            "repeat_words",
            F.expr(
                "aggregate(places, struct(0 as reached, 0 as total), (done, place) ->"
                f" struct(place + {_RUN} as reached, done.total + place + {_RUN} - greatest(done.reached, place) as total),"
                " done -> done.total)"
            ),
        )
    )


def cascade_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, highest first, as measured on a
    sample of about ``rows`` rows that spreads over the whole table. With an
    empty table the given order stays."""
    total = docs.count()
    share = f"pmod(xxhash64({id_col}, monotonically_increasing_id()), {max(1, total // rows)}) = 0"
    sample = keep(docs.select(id_col, text_col).where(share).limit(rows))
    scored = []
    for at, rule in enumerate(rules):
        started = time.perf_counter()
        hit = _rejected(sample, id_col, text_col, rule)
        scored.append((-hit / (time.perf_counter() - started), at, rule))
    return [rule for *_, rule in sorted(scored, key=lambda x: x[:2])]


def _rejected(sample: DataFrame, id_col: str, text_col: str, rule: Rule) -> int:
    return measured(sample, id_col, text_col, rule.measures).where(rule.rejects).count()


def verdict(rules) -> Column:
    """Name of the first rule of the cascade that rejects; null if none does.
    Later branches are not evaluated."""
    branches = " ".join(f"when {rule.rejects} then '{rule.name}'" for rule in rules)
    return F.expr(f"case {branches} end")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, measures of the rules, base_failed, rejected_by, kept), one row for
    each row of ``docs`` in any order of ids, repeated ids included.

    A null or empty text has measures of 0 and fails. base_failed is true when
    one of BASE_RULES rejects. rejected_by names the first rule that rejected
    in the cascade's order, which rests on measured times and may differ from
    run to run; kept does not. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    order = cascade_order(docs, id_col, text_col, rules, rows)
    measures = list(dict.fromkeys(m for rule in rules for m in rule.measures))
    base = " or ".join(f"({rule.rejects})" for rule in BASE_RULES)
    out = measured(docs, id_col, text_col, measures)
    return out.select(
        F.col("id").alias(id_col),
        *measures,
        F.expr(base).alias("base_failed"),
        verdict(order).alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed"))
