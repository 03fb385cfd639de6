"""Exact top-k inner products with KD-trees per shard.

Vectors are dealt by a hash to shards of bounded size, and each shard becomes a
KD-tree: median splits along the widest side, a tight bounding box per node. A
task takes a block of queries through a group of shards. For a query it visits
nodes in the order of their bounds (the largest product that a vector in the
box can reach) and leaves the tree when no box can beat the k-th score so far,
which it carries from shard to shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm.common import keep, parts, prepare

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LEAF = 128


def top_products(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries: str = "vec_id % 50 = 0",
    k: int = 5,
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects
    the k largest integer products with all rows of other ids, ties to the
    smaller id; all of them where there are fewer.

    A component x counts as floor(scale * x). Vectors that are null or hold a
    null or non-finite component, and rows with a null id, take no part; only
    vectors of equal length meet. Rows equal in id and vector count once; rows
    that share an id but not the vector are one candidate and one query, by the
    best of their products. An empty
    vector has product 0 with others. Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    whole = f"forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.where(f"{id_col} is not null and {vector_col} is not null and {whole}").selectExpr(
        f"cast({id_col} as bigint) id",
        f"transform({vector_col}, x -> floor({scale} * cast(x as double))) vector",
        f"coalesce({queries}, false) asks",
    )
    rows = keep(rows.distinct().withColumn("dim", F.size("vector")))
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / SHARD_ROWS).alias("shards"), F.ceil(F.count_if("asks") / BLOCK_QUERIES).alias("blocks")
    )
    sizes = keep(sizes.where("blocks > 0").withColumn("runs", F.least("shards", F.lit(parts(rows)))))
    rows = rows.join(F.broadcast(sizes), "dim")  # a row for each vector length
    dealt = "xxhash64(id, vector)"
    trees = (
        rows.selectExpr("dim", "runs", "blocks", f"pmod({dealt}, shards) part", "id", "vector")
        .groupBy("dim", "runs", "blocks", "part")
        .applyInArrow(_tree, "dim int, runs long, blocks long, part long, ids binary, vectors binary, boxes binary")
    )
    asked = (
        rows.where("asks")
        .selectExpr("dim", "runs", "blocks", f"pmod({dealt}, blocks) part", "id", "vector")
        .groupBy("dim", "runs", "blocks", "part")
        .applyInArrow(_block, "dim int, runs long, blocks long, part long, ids binary, vectors binary, boxes binary")
    )
    task = asked.selectExpr("dim", "part block", "explode(sequence(0l, runs - 1)) run", "0 kind", "part", "ids", "vectors", "boxes")
    task = task.unionByName(
        trees.selectExpr("dim", "explode(sequence(0l, blocks - 1)) block", "pmod(part, runs) run", "1 kind", "part", "ids", "vectors", "boxes")
    )
    task = task.repartition("dim", "block", "run").sortWithinPartitions("dim", "block", "run", "kind", "part")
    best = task.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = group["id"].to_numpy()
    flat = group["vector"].combine_chunks().flatten().to_numpy()
    return ids, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), np.int64)


def _row(group: pa.Table, ids: np.ndarray, vectors: np.ndarray, boxes: bytes) -> pa.Table:
    head = [group[c].slice(0, 1) for c in ("dim", "runs", "blocks", "part")]
    body = [pa.array([x], pa.binary()) for x in (ids.tobytes(), vectors.tobytes(), boxes)]
    return pa.table([*head, *body], names=["dim", "runs", "blocks", "part", "ids", "vectors", "boxes"])


def _block(group: pa.Table) -> pa.Table:
    ids, vectors = _matrix(group)
    return _row(group, ids, vectors, b"")


def _tree(group: pa.Table) -> pa.Table:
    ids, vectors = _matrix(group)
    order, boxes = build(vectors)
    return _row(group, ids[order], vectors[order], boxes.tobytes())


def halves(count: int) -> list[tuple[int, int]]:
    """Row ranges of a tree's nodes in heap order: the children of node i are
    2i + 1 and 2i + 2; all leaves are on one level."""
    level, out = [(0, count)], [(0, count)]
    while max(b - a for a, b in level) > LEAF:
        level = [part for a, b in level for part in ((a, (a + b) // 2), ((a + b) // 2, b))]
        out += level
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order of the tree, and its nodes' boxes as (nodes, 2, dim)."""
    ranges = halves(len(vectors))
    order = np.arange(len(vectors))
    boxes = np.zeros((len(ranges), 2, vectors.shape[1]), np.int64)
    for node, (a, b) in enumerate(ranges):
        if a == b:
            continue
        own = vectors[order[a:b]]
        boxes[node] = own.min(axis=0), own.max(axis=0)
        if 2 * node + 2 < len(ranges) and vectors.shape[1]:
            widest = int(np.argmax(boxes[node, 1].astype(float) - boxes[node, 0]))
            order[a:b] = order[a:b][np.argpartition(own[:, widest], (a + b) // 2 - a)]
    return order, boxes


def _exact(*arrays: np.ndarray) -> type:
    """A type in which sums of products are exact: doubles while these stay
    below 2^53, else Python's integers."""
    most = [max(1, int(np.abs(x.astype(float)).max(initial=0))) for x in arrays]
    return float if most[0] * most[1] * max(1, arrays[0].shape[-1]) < 2**53 else object


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, queries, best = None, np.zeros(0, np.int64), np.zeros((0, 0)), []

        def found() -> pa.RecordBatch:
            flat = [(int(q), -i, s) for q, top in zip(ids, best, strict=True) for s, i in top]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in flat], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(own), row["dim"])
                if row["kind"] == 0:
                    if at is not None:
                        yield found()
                    at, ids, queries, best = (row["dim"], row["block"], row["run"]), own, vectors, [[] for _ in own]
                elif at == (row["dim"], row["block"], row["run"]):
                    boxes = np.frombuffer(row["boxes"], np.int64).reshape(-1, 2, row["dim"])
                    search(ids, queries, best, own, vectors, boxes, k)
        if at is not None:
            yield found()

    return run


def search(ids, queries, best, own, vectors, boxes, k: int) -> None:
    """Improve each query's ``best``, a heap of (score, -id) with distinct ids,
    worst first."""
    kind = _exact(queries, vectors)
    queries, vectors, boxes = queries.astype(kind), vectors.astype(kind), boxes.astype(kind)
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = above @ boxes[:, 1].T + below @ boxes[:, 0].T
    ranges = halves(len(own))
    first_leaf = len(ranges) // 2
    for q, top in enumerate(best):
        line = bounds[q]
        heap = [(-line[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(top) == k and -bound < top[0][0]:
                break
            if node < first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if len(top) < k or line[child] >= top[0][0]:
                        heapq.heappush(heap, (-line[child], child))
                continue
            a, b = ranges[node]
            scores = vectors[a:b] @ queries[q]
            worth = np.arange(b - a) if len(top) < k else np.flatnonzero(scores >= top[0][0])
            for i in worth.tolist():
                entry = (int(scores[i]), -int(own[a + i]))
                if -entry[1] == ids[q]:
                    continue
                same = next((n for n, x in enumerate(top) if x[1] == entry[1]), None)
                if same is not None:  # an id takes one place, with its best product
                    if entry > top[same]:
                        top[same] = entry
                        heapq.heapify(top)
                elif len(top) < k:
                    heapq.heappush(top, entry)
                elif entry > top[0]:
                    heapq.heapreplace(top, entry)
