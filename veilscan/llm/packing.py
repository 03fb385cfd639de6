"""Packing token streams into sequences: concatenate and cut.

All documents form one stream, partition after partition. The first pass encodes
every document once and keeps its ids with the sum of the tokens before it in
its partition; prefix sums over the partitions' totals then give each document
its global offset, so nothing is sorted or shuffled. The second pass cuts the
stream into fixed windows: a document gives one record for each window that it
touches, so records at a window's border belong to documents that were cut
there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm.common import keep, prepare
from veilscan.llm.tokens import word_ids

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32, doc_tokens (with the closing ``end_id``), sequence_id and offset;
    with ``ids`` also the piece's ids as binary, to write sequences from.

    Sequences are full but for the last. A null or empty text is its closing id
    alone. Every row is a document of its own, repeated ids and equal rows
    included. A null id is kept. An empty table gives an empty result; other
    columns are ignored. The order of the stream is that of the rows in the
    partitions of ``docs``.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = keep(rows.mapInArrow(_encoded(tokenizer, end_id), ENCODED))
    # a row per partition
    totals = encoded.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    placed = encoded.join(F.broadcast(starts), "part").selectExpr("doc_id", "ids", "start + before at")
    schema = PIECES + (", ids binary" if ids else "")
    return placed.mapInArrow(_pieces(window, ids), schema)


ENCODED = "part int, before long, doc_id long, tokens long, ids binary"


def _encoded(path: str, end_id: int):
    """Each document's ids (two bytes each) and its place in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, closing = word_ids(path), end_id.to_bytes(2, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [found + closing for found in words.encode(batch.column(1).to_pylist())]
            tokens = np.array([len(x) // 2 for x in ids], np.int64)
            places = before + np.cumsum(tokens) - tokens
            before += int(tokens.sum())
            arrays = [
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(places),
                batch.column(0),
                pa.array(tokens),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "before", "doc_id", "tokens", "ids"])

    return run


def _pieces(window: int, with_ids: bool):
    names = [part.split()[0] for part in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, payload = [], []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, packed, at in zip(*columns, strict=True):
                ids = np.frombuffer(packed, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, window)
                    piece = ids[start : start + window - offset].tobytes()
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), len(ids), sequence, offset))
                    if with_ids:
                        payload.append(piece)
                    start += length
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            if with_ids:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(payload, pa.binary())], [*names, "ids"])
            else:
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run
