"""Token counts of the sections of documents, from one encoding of the whole.

A document is encoded once. The byte lengths of its tokens give their spans,
and an interval join of these with the section bounds attributes every token:
a token inside one section counts there; a token that crosses bounds goes to the
section that holds most of its bytes, the earlier of equal ones. The counts of a
document's sections therefore add up to the tokens of the document, which
encodings of the single sections do not.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import prepare
from veilscan.llm.hashing import text_buffer

SECTIONS = "section long, start long, length long, n_tokens long, n_crossing long"
#: White space that is encoded apart from this many characters on: the pattern
#: is matched with a stack that a million of them overflow.
LONG_SPACE = 100_000
_SPACES = re.compile(
    "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE
)


def section_tokens(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] | None = None
) -> DataFrame:
    """(doc_id, section, start, length, n_tokens, n_crossing): a row for each
    section, which is a line with its line break. start and length are in code
    points; n_crossing counts the tokens of the section that reach into others.
    ``ranks`` and ``pattern`` are the tokenizer's file and word pattern.

    With ``fields`` a document is the text of these columns, each but the last
    followed by a line break, and its sections are the fields, in order.

    A null or empty text has one empty section; a null field is empty. Every row
    stands for itself, repeated and null ids included. An empty table gives an
    empty result; other columns are ignored. Texts of any length are encoded
    whole, a batch at a time; a run of white space of LONG_SPACE characters or
    more is one word of the pattern but for its last character, as patterns
    that end in ``\\s+(?!\\S)|\\s+`` make it, and is encoded as such.
    """
    prepare(docs.sparkSession)
    if fields:
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
        parts = [F.concat(c, F.lit("\n")) for c in columns[:-1]] + columns[-1:]
        text, sizes = F.concat(*parts), F.array(*[F.char_length(c).cast("long") for c in parts])
    else:
        text, sizes = F.col(text_col), F.lit(None).cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), sizes.alias("sizes"))
    return rows.mapInArrow(_counted(ranks, pattern), f"doc_id long, {SECTIONS}")


def _counted(ranks: str, pattern: str):
    names = ["doc_id", *(part.split()[0] for part in SECTIONS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(ranks, pattern)
        for batch in batches:
            parts = [[] for _ in names]
            buffer, offsets = text_buffer(batch.column(1))
            columns = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, text, sizes, a, b in zip(*columns, offsets[:-1], offsets[1:], strict=True):
                data = buffer[a:b]
                if sizes is None:
                    breaks = np.flatnonzero(data == 10) + 1
                    bounds = np.concatenate(([0], breaks[breaks < len(data)], [len(data)]))
                else:
                    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    bounds = places[np.concatenate(([0], np.cumsum(sizes)))]
                ids = encode(encoding, text or "")
                tokens, crossing = attribute(np.cumsum(lengths[ids]), bounds)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[bounds]
                count = len(bounds) - 1
                for part, values in zip(parts, (None, np.arange(count), chars[:-1], np.diff(chars), tokens, crossing), strict=True):
                    part.append(pa.array(np.asarray(values, np.int64)) if values is not None else pa.array([doc_id] * count, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) if p else pa.array([], pa.int64()) for p in parts], names)

    return run


def encode(encoding, text: str) -> np.ndarray:
    """Ids of a whole text. Long white space is cut out where the pattern ends a
    word: behind the character before it, and before its own last character
    unless the text ends with it."""
    out, at = [], 0
    for space in _SPACES.finditer(text):
        end = space.end() if space.end() == len(text) else space.end() - 1
        out.append(encoding.encode_to_numpy(text[at : space.start()], disallowed_special=()))
        out.append(np.array(encoding._encode_single_piece(text[space.start() : end]), np.uint32))
        at = end
    out.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return out[0] if len(out) == 1 else np.concatenate(out)


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ``ends`` are the ends of the
    tokens, ``bounds`` the n+1 bounds of the sections, both in bytes."""
    count = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    # of sections that are empty at a bound, none holds a token
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    across = np.flatnonzero(first != last)
    for i in across.tolist():
        cuts = np.concatenate(([starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]))
        first[i] += int(np.argmax(np.diff(cuts)))
    return np.bincount(first, minlength=count), np.bincount(first[across], minlength=count)


def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for word, rank in table.items():
        lengths[rank] = len(word)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
