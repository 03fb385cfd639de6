"""Conversations rendered by a compiled template, with the parts that a model
is to learn marked, and the way back from the rendered text.

A rendered turn is ``### role: text</turn>`` and a line break. Inside texts and
roles, backslashes and control strings get a backslash before them, so what a
user writes never reads as a turn, and taking these backslashes away gives the
text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import prepare

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def escape_role(text: str) -> str:
    return _ROLE_CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}
RENDERED = "conv_id long, part long, text string, generated array<struct<start: int, end: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def render(conversations: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, part, text, generated): the formatted conversations, a row for
    each turn; the parts of a conversation in order are its formatted text.
    ``generated`` holds the spans (code points of the part) that the template
    marks. Needs the columns role and text.

    Turns go by number, null first, and equal numbers by role and text. Equal
    rows are turns of their own. A null text or role is empty; rows with a null
    id are one conversation. An empty table gives an empty result; other columns
    are ignored. A conversation's rows meet in one task as a sorted stream, of
    which only a turn is in memory.
    """
    prepare(conversations.sparkSession)
    empty = F.lit("")
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_rendered(template), RENDERED)


def _rendered(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilscan.llm.templates import compile_template

        write = compile_template(template, FILTERS)
        at, part, started = None, 0, False
        for batch in batches:
            texts, parts, spans = [], [], []
            for row in batch.to_pylist():
                part = part + 1 if started and row["conv_id"] == at else 0
                at, started = row["conv_id"], True
                out: list[str] = []
                marks: list[dict] = []
                length = 0

                def emit(text: str, generated: bool) -> None:
                    nonlocal length
                    if generated and text:
                        marks.append({"start": length, "end": length + len(text)})
                    out.append(text)
                    length += len(text)

                write({"messages": [row]}, emit)
                texts.append("".join(out))
                parts.append(part)
                spans.append(marks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(parts, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["conv_id", "part", "text", "generated"],
            )

    return run


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: n_turns, turns_sha256
    over role, line break, text, line break of every turn, loss_chars and
    loss_sha256 of the marked text without escapes, and formatted_chars."""
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digests, DIGESTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    state = None

    def row() -> tuple:
        at, turns, turns_hash, chars, loss_hash, formatted = state
        return at, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted

    for batch in batches:
        done = []
        for each in batch.to_pylist():
            if state is None or state[0] != each["conv_id"]:
                if state is not None:
                    done.append(row())
                state = [each["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text, reached = each["text"], 0
            for turn in _TURN.finditer(text):
                if turn.start() != reached:
                    raise ValueError(f"conversation {each['conv_id']}: text between turns")
                reached = turn.end()
                state[1] += 1
                state[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            if reached != len(text):
                raise ValueError(f"conversation {each['conv_id']}: no turn at {reached}")
            for span in each["generated"]:
                loss = unescape(text[span["start"] : span["end"]])
                state[3] += len(loss)
                state[4].update(loss.encode())
            state[5] += len(text)
        yield _table(done, names)
    if state is not None:
        yield _table([row()], names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
