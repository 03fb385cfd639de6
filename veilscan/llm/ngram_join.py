"""Similarity join on word shingles with parity sketches.

A document's sketch is a long bit vector in which every shingle flips the bit
that its hash names. The sketches of two documents differ in at most as many
bits as their shingle sets differ in elements, and two sets with a similarity
of at least t differ in at most (1 - t) / (1 + t) * (a + b) elements. So when
the bits are cut into m pieces, at least m - d pieces of a linked pair are
equal (d being that bound): the pair meets when equal pieces are joined. Each
document sends the d + 1 pieces that come first in one order of all pieces,
which by pigeonhole still share one. The order puts rare pieces first, so a
line that half the corpus holds brings nothing together; it rests on counts of
all pieces of all documents, hashed into a table of fixed size, and any table
gives the same links.

Pieces are compared by a 64-bit fingerprint of their bits, and a pair that met
is tested by the Hamming distance of narrow sketches and then on its sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import forget, keep, prepare
from veilscan.llm.graph import components
from veilscan.llm.hashing import U, mix64, shingle_sets

#: Sizes within a factor of four share a band and its number of pieces.
BAND = 4
#: Entries of the table of piece counts, and entries that travel as one row.
COUNT_SLOTS = 1 << 18
COUNT_CHUNK = 1 << 12
#: Bits of a sketch, at most, in the comparison before that of the sets.
MOST_BITS = 1 << 17
#: 64-bit words of the sketches that a join condition compares; a power of two.
#: Each of a document's buckets brings them along.
SHORT_WORDS = 8
#: Pairs up to this number are sent to the texts; more meet them in a shuffle.
SMALL_ROWS = 500_000
#: Members of a pair's first document that one task's group may hold.
GROUP = 512


def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets
    of ``words``-word shingles (A-Z lowered); component_id is the smallest id
    reachable by links. Null and wordless texts have no shingles and link with
    nothing. Rows that repeat an id are one document with several texts: any of
    them links it. A row with a null id gets its count and a null component. An
    empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _content(text_col))
    copies = keep(docs.select("id", "content"))
    named = docs.where("id is not null")
    profile = keep(docs.select("content", "text").mapInArrow(_profiles(words, percent), PROFILE))
    known = profile.where("content is not null").dropDuplicates(["content"])
    classes = known.select("content", "n_shingles").join(copies.groupBy("content").agg(F.min("id").alias("first")), "content")
    linked = copies.join(classes, "content").where("n_shingles > 0 and id <> first").selectExpr("id a", "first b")
    sketches = copies.join(known, "content").select("id", F.col("sketch").alias("payload"))
    short = copies.join(known, "content").select("id", "short")
    texts = named.select("id", F.col("text").alias("payload"))

    buckets = keep(_buckets(named, words, percent, _rarity(profile)))
    stars = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"), "n", "leader_n")
    scrap: list[DataFrame] = []
    found = _links(texts, sketches, _sized(stars, "n", "leader_n", percent), words, percent, scrap)
    groups = components(linked.unionByName(found))
    forget(scrap)
    pairs = _between_components(buckets, groups, short, percent, scrap)
    late = keep(_links(texts, sketches, pairs, words, percent, scrap))
    if not late.isEmpty():
        groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late))
    scrap += [buckets, late]
    forget(scrap)
    return (
        copies.join(classes, "content")
        .join(groups, "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n_shingles").cast("long").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )


def _content(column: str):
    """Equal for equal texts only; null and empty are one."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")))).alias("content")


# --- sketches ---------------------------------------------------------------


def most_different(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets with a and b elements."""
    return (100 - percent) * (a + b) // (100 + percent)


def pieces(level: int, percent: int) -> int:
    """Pieces of a sketch: well above the number that may differ, so that
    enough of them hold elements."""
    top = BAND ** (level + 1)
    return max(64, -(-9 * most_different(top, 100 * top // percent, percent) // 5))


def levels(size: int, percent: int) -> list[tuple[int, int]]:
    """(level, pieces that may differ) of the bands in which a set of this size
    meets its partners: a pair meets in the band of its smaller set."""
    own = (size.bit_length() - 1) // (BAND.bit_length() - 1)
    out = [(own, most_different(size, 100 * size // percent, percent))]
    below = BAND**own - 1
    if below and 100 * below >= percent * size:
        out.append((own - 1, most_different(size, below, percent)))
    return out


def piece_keys(found: np.ndarray, level: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch's pieces that hold elements, and these pieces."""
    piece = ((found >> U(32)) * U(pieces(level, percent))) >> U(32)
    cuts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    held = piece[cuts]
    return mix64(np.bitwise_xor.reduceat(found, cuts) ^ _place(held, level)), held


def _place(piece: np.ndarray, level: int) -> np.ndarray:
    return mix64(piece + U((level + 1) << 40))


def sent_keys(found: np.ndarray, level: int, differ: int, percent: int, rarity: np.ndarray) -> np.ndarray:
    """The first ``differ + 1`` keys in the order of all pieces: rare ones
    first, pieces without elements last."""
    keys, held = piece_keys(found, level, percent)
    wanted = differ + 1
    if len(keys) > wanted:
        order = (rarity[keys >> U(46)].astype(np.uint64) << U(56)) | (keys >> U(8))
        return keys[np.argpartition(order, wanted - 1)[:wanted]]
    if len(keys) < wanted:
        free = np.setdiff1d(np.arange(pieces(level, percent), dtype=np.uint64), held)
        empty = np.sort(mix64(_place(free, level)))[: wanted - len(keys)]
        keys = np.concatenate((keys, empty))
    return keys


def packed_sketch(found: np.ndarray) -> bytes:
    """The set's size in four bytes and a sketch of at least twice as many bits
    (a power of two). Halving a sketch, by flipping one half with the other,
    gives the sketch of half the bits, so sketches of all sizes compare."""
    bits = min(MOST_BITS, max(256, 1 << (2 * len(found)).bit_length()))
    parity = np.bincount((found & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(found).to_bytes(4, "little") + np.packbits(parity.astype(bool)).tobytes()


def short_sketch(found: np.ndarray) -> np.ndarray:
    """A sketch of SHORT_WORDS 64-bit words, for use in a join condition."""
    bits = np.bincount((found & U(64 * SHORT_WORDS - 1)).astype(np.int64), minlength=64 * SHORT_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def sketches_near(first: bytes, second: bytes, percent: int) -> bool:
    """Whether the Hamming distance leaves a link possible."""
    a, b = (np.frombuffer(x, np.uint8, offset=4) for x in (first, second))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    sizes = (int.from_bytes(x[:4], "little") for x in (first, second))
    return int(np.bitwise_count(a ^ b).sum()) <= most_different(*sizes, percent)


# --- candidate pairs --------------------------------------------------------

PROFILE = "content binary, n_shingles int, sketch binary, short array<long>, chunk int, counts binary"


def _profiles(words: int, percent: int):
    """Rows with each text's number of shingles and sketch, and at the end of
    the task its counts of pieces by hashed slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["content", "n_shingles", "sketch", "short", "chunk", "counts"]
        counts = np.zeros(COUNT_SLOTS, np.int64)
        seen: set[bytes] = set()
        for batch in batches:
            fresh = _unseen(batch.column(0), seen)
            batch = batch.take(fresh)
            sizes, sketches, short = np.zeros(len(fresh), np.int32), [], []
            for row, found in enumerate(shingle_sets(batch.column(1), words)):
                sizes[row] = len(found)
                sketches.append(packed_sketch(found))
                short.append(short_sketch(found))
                for level, _ in levels(len(found), percent) if len(found) else ():
                    keys, _ = piece_keys(found, level, percent)
                    np.add.at(counts, (keys >> U(46)).astype(np.int64), 1)
            none = pa.nulls(len(fresh), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(sketches, pa.binary()), pa.array(short, pa.list_(pa.int64())), none, pa.nulls(len(fresh), pa.binary())], names
            )
        if counts.any():
            cut = counts.reshape(-1, COUNT_CHUNK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(cut), pa.binary()),
                    pa.nulls(len(cut), pa.int32()),
                    pa.nulls(len(cut), pa.binary()),
                    pa.nulls(len(cut), pa.list_(pa.int64())),
                    pa.array(np.arange(len(cut), dtype=np.int32)),
                    pa.array([x.tobytes() for x in cut], pa.binary()),
                ],
                names,
            )

    return run


def _unseen(content: pa.Array, seen: set[bytes]) -> pa.Array:
    """Rows with texts that this task has not met: copies go no further."""
    out = []
    for row, value in enumerate(content.to_pylist()):
        if value not in seen:
            seen.add(value)
            out.append(row)
    return pa.array(out, pa.int64())


def _rarity(profile: DataFrame) -> np.ndarray:
    """Table of COUNT_SLOTS bytes: four times the binary logarithm of how
    often the pieces of a slot occur in the corpus."""
    rows = profile.where("chunk is not null").select("chunk", "counts")
    total = np.zeros((COUNT_SLOTS // COUNT_CHUNK, COUNT_CHUNK))
    for row in rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, rows.schema).collect():
        total[row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return np.minimum(4 * np.log2(total.ravel() + 1), 200).astype(np.uint8)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks, which arrive sorted."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    at, total = None, np.zeros(COUNT_CHUNK, np.int64)
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at is not None and chunk != at:
                yield out()
                total = np.zeros(COUNT_CHUNK, np.int64)
            at = chunk
            total = total + np.frombuffer(counts, np.int64)
    if at is not None:
        yield out()


def _sent(words: int, percent: int, rarity: np.ndarray):
    """A row for each key that a text sends; within a task, only one of equal
    texts sends any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.take(_unseen(batch.column(1), seen))
            ids = batch.column(0).to_numpy()
            keys, owners, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for row, found in enumerate(shingle_sets(batch.column(2), words)):
                for level, differ in levels(len(found), percent) if len(found) else ():
                    sent = sent_keys(found, level, differ, percent, rarity)
                    keys.append(sent)
                    owners.append(np.full(len(sent), ids[row]))
                    sizes.append(np.full(len(sent), len(found), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], owners, sizes)], ["key", "id", "n"]
            )

    return run


def _buckets(docs: DataFrame, words: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """Members of every key with more than one, once for each distinct set of
    members: (bucket, members, leader, leader_n, id, n); the leader is the
    smallest id. A text's keys spread over all partitions, so a large group of
    near copies is many keys, not one task."""
    sent = docs.select("id", "content", "text").mapInArrow(_sent(words, percent, rarity), "key long, id long, n int")
    of_key = "over (partition by key)"
    return (
        sent.selectExpr(
            "id",
            "n",
            f"count(*) {of_key} members",
            f"min(struct(id, n)) {of_key} head",
            f"bit_xor(xxhash64(id, n)) {of_key} mark",
        )
        .where("members > 1")
        .selectExpr("xxhash64(mark, members, head) bucket", "members", "head.id leader", "head.n leader_n", "id", "n")
        .distinct()
    )


def _sized(pairs: DataFrame, n: str, other: str, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link."""
    return pairs.where(f"100 * least({n}, {other}) >= {percent} * greatest({n}, {other})").select("a", "b").distinct()


def _between_components(
    buckets: DataFrame, groups: DataFrame, short: DataFrame, percent: int, scrap: list[DataFrame]
) -> DataFrame:
    """Pairs of a bucket that are still in different components and were not
    compared: those outside the leader's component with all. A bucket whose
    members are one component, as in a group of copies, has none. The join
    keeps a pair only if short sketches leave a link possible; from each bucket
    that its documents share comes a row of two numbers, of which one is left."""
    members = (
        buckets.where("members > 2")
        .join(groups, "id", "left")
        .select("bucket", "leader", "id", "n", F.coalesce("component", "id").alias("component"))
    )
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main"))
        .where("low <> high")
        .select("bucket", "main")
    )
    members = keep(members.join(mixed, "bucket").where("id <> leader").drop("leader"))
    scrap.append(members)
    # a document is in as many buckets as it sent keys, at most: a row must not
    # name the others, or their number would count twice
    words = short.selectExpr("id", *[f"short[{i}] s{i}" for i in range(SHORT_WORDS)])
    members = members.join(words, "id")
    x, y = members.where("component <> main").alias("x"), members.alias("y")
    distance = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SHORT_WORDS))
    tests = [
        "x.bucket = y.bucket",
        "x.component <> y.component",
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)",
        f"{100 + percent} * ({distance}) <= {100 - percent} * (x.n + y.n)",
    ]
    pairs = x.join(y, F.expr(" and ".join(f"({t})" for t in tests)))
    return pairs.selectExpr("least(x.id, y.id) a", "greatest(x.id, y.id) b").distinct()


# --- verification -----------------------------------------------------------


def _links(
    texts: DataFrame, sketches: DataFrame, pairs: DataFrame, words: int, percent: int, scrap: list[DataFrame]
) -> DataFrame:
    """The linked ones of the pairs (a, b): sketches, a small part of the texts
    in size, decide most; the sets of shingles decide the rest. The tables that
    are no longer needed when the result has been read are added to ``scrap``."""
    pairs = keep(pairs)
    near = keep(_matched(sketches, pairs, bytes_of, lambda a, b: sketches_near(a, b, percent)))
    scrap += [pairs, near]
    return _matched(texts, near, lambda column: shingle_sets(column, words), lambda a, b: sets_linked(a, b, percent))


def _matched(payloads: DataFrame, pairs: DataFrame, items, test) -> DataFrame:
    """Pairs whose payloads (id, payload) pass the test. Those that share a
    first document are compared in groups of about GROUP, each of which gets
    that document's payload, so no task holds all copies of one text."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("slots"))
    second = pairs.join(slots, "a").selectExpr("b id", "a", "cast(pmod(xxhash64(b), slots) as int) slot", "1 role")
    first = slots.selectExpr("a id", "a", "explode(sequence(0, slots - 1)) slot", "0 role")
    needed = second.unionByName(first)
    if pairs.count() <= SMALL_ROWS:  # at most two rows of ids for each: a few MB
        needed = F.broadcast(needed)
    rows = payloads.join(needed, "id").repartition("a", "slot").sortWithinPartitions("a", "slot", "role", "id")
    rows = rows.select("a", "slot", "role", "id", "payload")
    return rows.mapInArrow(_compared(items, test), "a long, b long").distinct()


def bytes_of(column: pa.Array) -> list[bytes]:
    return column.to_pylist()


def _compared(items, test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in batches:
            a, slot, role, ids = (batch.column(i).to_numpy().tolist() for i in range(4))
            links = []
            for row, item in enumerate(items(batch.column(4))):
                if group != (a[row], slot[row]):
                    group, heads = (a[row], slot[row]), []
                if role[row] == 0:
                    heads.append(item)
                elif any(test(item, head) for head in heads):
                    links.append((a[row], ids[row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return run


def sets_linked(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    if not len(first) or not len(second):
        return False
    at = np.minimum(np.searchsorted(second, first), len(second) - 1)
    both = int(np.count_nonzero(second[at] == first))
    return 100 * both >= percent * (len(first) + len(second) - both)
