"""Removing passages that an earlier document has, by seed and extend.

Seeds are winnowed anchors: of the k-word hashes in each window of the
threshold length, the smallest (the rightmost of equal ones) is the window's
anchor. Windows with equal words have equal anchors at equal places, so every
repeat over the threshold shares the anchors of all its windows, and each
window belongs to exactly one anchor occurrence.

Occurrences of an anchor are then extended both ways over all windows that
belong to them. Occurrences with equal extended contexts form a class; in a
class every occurrence but that of the smallest document repeats it entirely.
Only the first occurrences of the classes of an anchor that has several are
compared further, window by window. Matched windows are merged into maximal
spans per document and cut. All comparisons are groupings with a minimum, so a
passage that a third of the corpus holds makes a row per occurrence, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import frugal, keep, prepare
from veilscan.llm.hashing import U, Words, mix64

#: Words of a seed.
SEED = 12
#: Low bits of an anchor's rank that hold its place.
_PLACE = U((1 << 28) - 1)

ANCHORS = "anchor long, context long, id long, text_key long, start int, windows int"
WINDOWS = "anchor long, window long, id long, text_key long, start int"


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """``docs`` without the words of every ``words``-word window whose sequence
    also starts in a document with a smaller id, plus n_words and n_removed
    (long).

    Windows are judged on the input. The rest of a text stays as it is, white
    space included; a cut word goes with the white space behind it. A text
    without cuts, a null text and an empty text are returned unchanged.
    Repeats within one document, or between rows that repeat an id, are not
    cut. A row with a null id is left whole and cuts nothing. Input columns
    named n_words or n_removed are replaced; others are kept. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c not in (id_col, text_col)])
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    id_at, text_at = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    inner = inner.withColumn("id", F.col(id_at).cast("long")).withColumn("text_key", F.xxhash64(F.coalesce(text_at, F.lit(""))))
    texts = inner.where("id is not null").select("id", "text_key", F.col(text_at).alias("text"))
    joined = inner.join(repeated_spans(texts, words), ["id", "text_key"], "left")
    joined = joined.select(*inner.columns[: len(columns)], "spans")
    schema = inner.select(*joined.columns[:-1]).schema.add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(frugal(_cut(joined.columns.index(text_at))), schema).toDF(*columns, "n_words", "n_removed")


def repeated_spans(texts: DataFrame, words: int) -> DataFrame:
    """(id, text_key, spans): per text the runs of words to cut, as structs of
    first word and end; they may overlap. ``texts`` has id, text_key, text."""
    anchors = keep(texts.mapInArrow(frugal(_anchors(words)), ANCHORS))
    classes = anchors.groupBy("anchor", "context").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = (
        classes.groupBy("anchor")
        .agg(F.count("*").alias("n_classes"), F.min("first").alias("low"), F.max("last").alias("high"))
        .where("low < high")
        .select("anchor", "n_classes")
    )
    classes = classes.join(shared, "anchor").where("first < last or n_classes > 1").drop("last")
    met = keep(anchors.join(classes, ["anchor", "context"]).where("id > first or n_classes > 1"))
    whole = met.where("id > first").selectExpr("id", "text_key", f"struct(start, start + windows + {words - 1} as end) span")

    ranges = met.where("id = first").groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("ranges"))
    extended = keep(texts.join(ranges, ["id", "text_key"]).mapInArrow(frugal(_windows(words)), WINDOWS))
    earliest = extended.groupBy("anchor", "window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    matched = extended.join(earliest.select("anchor", "window", "low"), ["anchor", "window"]).where("id > low")
    single = matched.selectExpr("id", "text_key", f"struct(start, start + {words} as end) span")
    return whole.unionByName(single).groupBy("id", "text_key").agg(F.collect_list("span").alias("spans"))


def winnow(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, first window, number of windows) of every anchor
    occurrence in the column; places and windows count its words."""
    reach = size - seed + 1
    count = len(words.starts)
    ends = np.repeat(words.rows[1:], np.diff(words.rows))
    place = np.arange(count)
    valid = place + size <= ends
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    rank = (words.runs(seed) & ~_PLACE) | (_PLACE - place.astype(np.uint64))
    lows = _sliding_min(rank, reach)
    starts = np.flatnonzero(valid)
    at = (_PLACE - (lows[starts] & _PLACE)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[cuts], starts[cuts], np.diff(np.append(cuts, len(starts)))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each one on, by minima from both
    ends of fixed blocks."""
    blocks = -(-len(values) // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(values)], left[width - 1 : width - 1 + len(values)])


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            at, first, count = winnow(words, size, SEED)
            row = np.searchsorted(words.rows, first, side="right") - 1
            seeds, windows = words.runs(SEED), words.runs(size)
            context = mix64(windows[first] + windows[first + count - 1] * U(3) + (count + (at - first) * 64).astype(np.uint64))
            arrays = [
                seeds[at].view(np.int64),
                context.view(np.int64),
                batch.column(0).to_numpy()[row],
                batch.column(1).to_numpy()[row],
                (first - words.rows[row]).astype(np.int32),
                count.astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "context", "id", "text_key", "start", "windows"])

    return run


def _windows(size: int):
    """The windows of each range of a text, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            windows = words.runs(size)
            ranges = batch.column(3)
            row = np.repeat(np.arange(len(batch)), ranges.value_lengths().to_numpy(zero_copy_only=False))
            flat = ranges.flatten()
            anchor, start, count = (flat.field(i).to_numpy() for i in range(3))
            owner = np.repeat(np.arange(len(row)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
            row = row[owner]
            arrays = [
                anchor[owner],
                windows[words.rows[row] + place].view(np.int64),
                batch.column(0).to_numpy()[row],
                batch.column(1).to_numpy()[row],
                place.astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "window", "id", "text_key", "start"])

    return run


def _cut(text_at: int):
    """Replace the text by what its spans leave; the spans come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(text_at))
            counts = np.diff(words.rows)
            removed = np.zeros(len(batch), np.int64)
            texts = None
            for row, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not spans:
                    continue
                gone = np.zeros(counts[row] + 1, np.int32)
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["end"] for s in spans], -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed[row] = np.count_nonzero(gone)
                texts = texts or batch.column(text_at).to_pylist()
                texts[row] = _left(words, row, gone)
            columns = batch.columns[:-1]
            if texts is not None:
                columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts.astype(np.int64)), pa.array(removed)],
                [*batch.schema.names[:-1], "n_words", "n_removed"],
            )

    return run


def _left(words: Words, row: int, gone: np.ndarray) -> str:
    first, last = words.rows[row], words.rows[row + 1]
    begin, end = words.offsets[row], words.offsets[row + 1]
    follows = np.append(words.starts[first + 1 : last], end)  # where the word behind starts
    keeps = ~gone
    out = [words.bytes[begin : words.starts[first]].tobytes()]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keeps.view(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(words.bytes[words.starts[first + a] : follows[b - 1]].tobytes())
    return b"".join(out).decode()
