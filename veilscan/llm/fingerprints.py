"""Document fingerprints by locally consistent parsing.

A text is a string of names, at first of its code points. In each level equal
neighbours are drawn together into one block each, and deterministic coin
tossing labels every other name by the lowest bit in which it differs from the
one before, four times, until six labels are left of which no two neighbours are
equal. A block begins at every local maximum of the labels. The block's name is
a hash of the names in it, and the blocks are the string of the next level. As a
border depends on four names before it and one behind it, equal substrings are
parsed alike but for their ends, wherever they begin: they share the phrases of
their inside. A fingerprint holds the least hashed phrase names of a document
from the second level on (about eight characters and more), and the share of
common ones among the least of two fingerprints estimates the share of common
phrases of two documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import parts, prepare
from veilscan.llm.hashing import U, mix64

#: Phrase names in a fingerprint, and hexadecimal digits of each.
NAMES, DIGITS = 64, 10
#: Below so many code points the phrases of the first level count as well.
SHORT = 64
#: Code points parsed at once (a longer text is parsed alone).
BLOCK = 1 << 20
#: Buckets for each shuffle partition, and sampled keys for each bucket.
BUCKETS, SAMPLES = 4, 64

_OF_RUN = U(0xA0761D6478BD642F)
_LENGTH = U(0xE7037ED1A0B428DB)
_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64) * U(0x8EBC6AF09C88C6E3)) | U(1)


def _tossed(size: int) -> np.ndarray:
    """Labels for pairs (label before, label) of ``size`` labels each."""
    before, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = before ^ own
    lowest = np.bitwise_count(((differ & -differ) - 1).astype(np.uint64) & U(63)).astype(np.int64)
    return (2 * lowest + ((own >> lowest) & 1)).astype(np.uint8).reshape(-1)


#: 128 labels of 64 bits become 14, these 8, these 6.
_ROUNDS = [(size, _tossed(size)) for size in (128, 14, 8)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; one pass, no shuffle.

    A null or empty text has an empty fingerprint. Rows with null or repeated
    ids stay; an empty table gives an empty result; other columns are ignored.
    A task holds a batch of texts, and some forty bytes for each code point of
    the million (or of the one longer text) that it parses at once.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col))
    return rows.mapInArrow(_fingerprinted, "doc_id long, n_chars long, fingerprint string")


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against an edited text and against the next document:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is that with the next smaller id, after the last one the
    first; null ids come last, and rows with equal ids follow the order of a
    hash of their texts, then the texts. The edited text has the document's last
    half replaced by as much of the next one's beginning. Nulls, repeated rows,
    empty tables, other columns and memory as in ``fingerprint``.

    Texts are shuffled once, into buckets whose bounds are rows of the table
    (found on a sample of 64 keys a bucket, as a range partitioning does): the
    row at a bound also goes to the end of the bucket before it, where it is the
    next document. A bucket streams through its task; only equal rows cannot
    lie in different buckets.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col)).select(
        F.col("doc_id").isNull().alias("last"), F.expr("~coalesce(doc_id, 0L)").alias("down"), F.xxhash64("text").alias("tie"), "doc_id", "text"
    )
    bounds, first = _bounds(rows)
    dealt = rows.mapInArrow(_dealt(bounds, first), "bucket int, extra boolean, down long, last boolean, tie long, doc_id long, text string")
    ordered = dealt.repartition(parts(docs), "bucket").sortWithinPartitions("bucket", "extra", "last", "down", "tie", "text")
    return ordered.select("bucket", "extra", "doc_id", "text").mapInArrow(
        _compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _text(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


# --------------------------------------------------------------------- parsing


def parse(names: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the blocks, and which of them begin a document.
    ``fresh`` marks the names that do."""
    same = np.zeros(len(names), bool)
    same[1:] = (names[1:] == names[:-1]) & ~fresh[1:]
    run = same.copy()
    run[:-1] |= same[1:]
    opens = fresh.copy()  # of a stretch without equal neighbours, or of a run
    opens[1:] |= run[:-1]
    opens &= ~run
    before = np.empty_like(names)
    before[1:] = names[:-1]
    np.copyto(before, names ^ U(1), where=opens | fresh)
    before ^= names
    before &= ~before + U(1)
    lowest = np.bitwise_count(before - U(1))
    lowest &= np.uint8(63)
    labels = 2 * lowest + ((names >> lowest) & U(1)).astype(np.uint8)
    del before, lowest
    for size, table in _ROUNDS:
        pair = np.empty(len(labels), np.uint16)
        pair[1:] = labels[:-1]
        np.copyto(pair, labels ^ np.uint8(1), where=opens | fresh)
        pair *= np.uint16(size)
        pair += labels
        # labels inside runs mean nothing and may lie outside the table
        labels = table.take(pair, mode="clip")
    peaks = np.zeros(len(names), bool)
    if len(names) > 2:
        peaks[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        peaks[1:-1] &= ~(run[1:-1] | run[2:] | fresh[2:] | opens[1:-1])
    begins = np.flatnonzero(peaks | opens | fresh | (run & ~same))
    lengths = np.diff(np.append(begins, len(names)))
    inside = np.arange(len(names)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(names * _WEIGHTS[np.minimum(inside, 63)], begins)
    runs = run[begins]
    sums[runs] = names[begins[runs]] * _OF_RUN
    return mix64(sums + lengths.astype(np.uint64) * _LENGTH), fresh[begins]


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, phrase name) of all phrases that fingerprints draw from."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owners = np.flatnonzero(sizes)
    short = sizes < SHORT
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    names = mix64(names + _LENGTH)
    sizes = sizes[owners]
    of, found, level = [], [], 0
    while len(owners):
        level += 1
        fresh = np.zeros(len(names), bool)
        fresh[np.cumsum(sizes) - sizes] = True
        names, fresh = parse(names, fresh)
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(names)))
        if level > 1:
            of.append(np.repeat(owners, sizes))
            found.append(names)
        else:
            mine = np.repeat(short[owners], sizes)
            of.append(np.repeat(owners, sizes)[mine])
            found.append(names[mine])
        more = sizes > 1
        if level == 1:
            more |= ~short[owners]  # a text of one run has its only phrase here
        names, owners, sizes = names[np.repeat(more, sizes)], owners[more], sizes[more]
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(of), np.concatenate(found)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The least hashed phrase names of each text, in order."""
    out: list[np.ndarray] = []
    reached = np.cumsum([len(t) for t in texts]) // BLOCK
    for block in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(reached)) + 1):
        of, names = phrases([texts[i] for i in block])
        bits = U(4 * DIGITS)
        keyed = np.unique((of.astype(np.uint64) << bits) | (mix64(names ^ _OF_RUN) >> (U(64) - bits)))
        starts = np.searchsorted(keyed >> bits, np.arange(len(block) + 1, dtype=np.uint64))
        values = keyed & U((1 << 4 * DIGITS) - 1)
        out += [values[i : min(i + NAMES, j)] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the least of both; 1 for two empty ones."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    fresh = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=fresh[1:])
    firsts = np.flatnonzero(fresh)[:NAMES]
    twice = np.append(fresh[1:], True)
    return float(np.count_nonzero(~twice[firsts]) / len(firsts))


# -------------------------------------------------------------------- in tasks


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(s) for s in sketches(texts)], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint"])


def _bounds(rows: DataFrame) -> tuple[list[tuple], tuple | None]:
    """Keys (last, down, tie) of rows at which buckets begin, and the first of
    all keys, which is none of them."""
    key = ["last", "down", "tie"]
    buckets = BUCKETS * parts(rows)
    first = rows.agg(F.min(F.struct("last", "down")).alias("m")).head()["m"]
    if first is None:
        return [], None
    tie = rows.where((F.col("last") == first["last"]) & (F.col("down") == first["down"])).agg(F.min("tie")).head()[0]
    least = (first["last"], first["down"], tie)
    every = max(1, rows.count() // (SAMPLES * buckets))
    found = rows.where(F.expr(f"pmod(xxhash64(down, tie, 17), {every}) = 0")).select(key).toArrow()
    keys = sorted(zip(*(found.column(k).to_pylist() for k in key), strict=True))
    chosen = {keys[len(keys) * i // buckets] for i in range(1, buckets)} if keys else set()
    return sorted(chosen - {least}), least


def _dealt(bounds: list[tuple], first: tuple | None):
    """Each row in its bucket, and again behind the bucket before if it is the
    row at a bound, or behind the last bucket if it is the first of all."""
    heads = {bound: bucket for bucket, bound in enumerate(bounds)}
    heads[first] = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, down, tie = (batch.column(i).to_pylist() for i in range(3))
            keys = list(zip(last, down, tie, strict=True))
            rows, buckets, extra = list(range(len(keys))), [bisect_right(bounds, k) for k in keys], [False] * len(keys)
            for i, k in enumerate(keys):
                if k in heads:
                    rows.append(i)
                    buckets.append(heads[k])
                    extra.append(True)
            taken = pa.Table.from_batches([batch]).take(pa.array(rows)).combine_chunks()
            columns = [pa.array(buckets, pa.int32()), pa.array(extra), taken.column("down"), taken.column("last"), taken.column("tie"), taken.column("doc_id"), taken.column("text")]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "extra", "down", "last", "tie", "doc_id", "text"])

    return run


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row: bucket, extra, id, text, sketch
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        own = sketches(columns[3])
        rows = ([held] if held else []) + list(zip(*columns, own, strict=True))
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
        changed = [edited(a[3], b[3]) for a, b in pairs]
        theirs = sketches(changed)
        arrays = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([as_text(a[4]) for a, _ in pairs], pa.string()),
            pa.array([as_text(s) for s in theirs], pa.string()),
            pa.array([likeness(a[4], s) for (a, _), s in zip(pairs, theirs, strict=True)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
