"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

A suffix is the run of at most four words from a word to the end of its piece.
Every task sorts the suffixes of a block of texts, merges equal ones into one
with a count, and deals them globally by their leading words: bounds over the
order of word hashes, taken from a sample as Spark's own range partitioning
does, cut all suffixes into buckets, so that a leading word or pair with a third
of all rows is cut too. In a bucket the pointers are partitioned three ways by
the word at their depth; the partition that equals the pivot goes one word
deeper, and its size is the count of the phrase that its suffixes begin with. A
partition with fewer suffixes than the least count is abandoned: all that begin
with its words are in this bucket. Only a phrase at a bucket's bounds may
continue in the next one; its part is reported whatever its size, and the parts
are added up.

Words are compared by 64-bit hashes (see ``hashing``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import keep, parts, prepare
from veilscan.llm.hashing import U, _spans, _word_hashes, _CODES, mix64, text_buffer

#: Words of the longest phrase.
DEPTH = 4
#: Words that a task sorts at once.
BLOCK_WORDS = 1 << 19
#: Buckets for each shuffle partition, and sampled suffixes for each bucket.
BUCKETS, SAMPLES = 4, 100

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[9, 32]] = True

RUNS = "bucket int, langs array<string>, lang_of binary, words binary, shape binary, counts binary"
COUNTS = "lang string, k int, phrase string, f long"


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    top: int = 2000,
    absorbed: int = 80,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to 4 words of one piece, A-Z lowered, and occurs ``least``
    times or more. Its score is floor(2000000 * a / (l + r)) of its lowest cut.
    It is dropped if a longer such phrase that contains it has at least
    ``absorbed`` percent of its occurrences. A null text is empty, a null
    language ``und``; repeated rows count each; an empty table gives an empty
    result; other columns are ignored. A task holds a batch of texts and half a
    million words, and later one bucket: a part of all suffixes that shrinks
    with ``spark.sql.shuffle.partitions``.
    """
    return ranked(keep(phrase_counts(docs, text_col, lang_col, least)), top, absorbed)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> DataFrame:
    """lang, k, phrase and f of every phrase of k = 1 to 4 words with f at least
    ``least``; the row with k = 0 holds the number of words of the language."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    bounds = _bounds(rows, BUCKETS * parts(docs))
    runs = rows.mapInArrow(_sorted_runs(bounds), RUNS)
    counted = runs.groupBy("bucket").applyInArrow(_counted(bounds, least), COUNTS)
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(f"k = 0 or f >= {int(least)}")


def ranked(counts: DataFrame, top: int = 2000, absorbed: int = 80) -> DataFrame:
    """The ranking of a table of counts (lang, k, phrase, f). Products are taken
    as decimals, exact beyond 64 bits."""
    wide = "cast({} as decimal(20, 0))".format
    held = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    part = "array_join(slice(ws, {}, {}), ' ')".format
    cuts = held.where("k >= 2").select(
        "lang", "phrase", "a", "ws", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")
    ).selectExpr("lang", "phrase", "a", "cut", f"{part(1, 'cut')} first", f"{part('cut + 1', 'k - cut')} rest")
    known = counts.where("k between 1 and 3")
    firsts = known.selectExpr("lang", "phrase first", "f l")
    rests = known.selectExpr("lang", "phrase rest", "f r")
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).selectExpr(
        "lang", "phrase", "a", f"struct((2000000BD * {wide('a')}) div ({wide('l')} + {wide('r')}) as score, cut, l, r) as of_cut"
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min("of_cut").alias("lowest"))
    inner = held.where("k >= 3").select(
        "lang", "a", "ws", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size")
    ).select("lang", "a", "ws", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    longer = inner.selectExpr("lang", f"{part('at', 'size')} phrase", "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        f"longer is null or 100BD * {wide('longer')} < {int(absorbed)}BD * {wide('a')}"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score").withColumn("rank", F.row_number().over(order).cast("long"))
    # a row per language
    totals = counts.where("k = 0").selectExpr("lang", "f n")
    return out.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


class Suffixes:
    """Words of texts, lowered, with their languages and the number of words
    that the suffix from each of them has."""

    def __init__(self, texts: pa.Array, langs: list[str], lang_of: np.ndarray):
        buffer, offsets = text_buffer(texts)
        self.bytes = _LOWERED[buffer]
        self.starts, self.ends = _spans(self.bytes, offsets, _BETWEEN)
        self.langs = langs
        self.lang_of = np.repeat(lang_of, np.diff(np.searchsorted(self.starts, offsets)))
        self.hashes = _in_lang(_word_hashes(self.bytes, self.starts, self.ends, _CODES), langs, self.lang_of)
        count = len(self.starts)
        self.left = np.zeros(count, np.int64)
        if count:
            breaks = np.concatenate([[0], np.cumsum(_ENDS_PIECE[self.bytes])])
            fresh = np.ones(count, bool)
            fresh[1:] = breaks[self.starts[1:]] != breaks[self.ends[:-1]]
            fresh[np.searchsorted(self.starts, offsets[:-1])[np.diff(np.searchsorted(self.starts, offsets)) > 0]] = True
            firsts = np.append(np.flatnonzero(fresh), count)
            ends = np.repeat(firsts[1:], np.diff(firsts))
            self.left = np.minimum(ends - np.arange(count), DEPTH)

    def words(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the word at each suffix's depth, 0 where it has ended."""
        inside = self.left[at] > depth
        out = np.zeros(len(at), np.uint64)
        out[inside] = self.hashes[at[inside] + depth]
        return out

    def order_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading and trailing half of the key that deals suffixes out."""
        return _pair(self.words(at, 0), self.words(at, 1)), _pair(self.words(at, 2), self.words(at, 3))

    def text(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, each with a space behind, and where each begins."""
        lengths = self.ends[words] - self.starts[words] + 1
        begins = np.append(0, np.cumsum(lengths))
        padded = np.append(self.bytes, np.uint8(32))
        out = padded[np.arange(begins[-1]) + np.repeat(self.starts[words] - begins[:-1], lengths)]
        out[begins[1:] - 1] = 32
        return out, begins


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first >> U(32) << U(32)) | (second >> U(32))


def _in_lang(words: np.ndarray, langs: list[str], lang_of: np.ndarray) -> np.ndarray:
    """Hashes of words of which each language has its own."""
    digests = (hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest() for lang in langs)
    return mix64(words ^ np.array([int.from_bytes(d, "little") for d in digests], np.uint64)[lang_of])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """The texts of a batch in blocks of bounded size (a longer text is a block
    of its own)."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False)
        sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes // (4 * BLOCK_WORDS))) + 1):
            if len(rows):
                texts = batch.column(1).slice(rows[0], len(rows))
                yield Suffixes(texts, langs.dictionary.to_pylist(), lang_of[rows])


# --------------------------------------------------------------------- bounds


def _bounds(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys at which buckets begin, at most buckets - 1 of them."""
    sources = max(1, rows.rdd.getNumPartitions())
    size = -(-3 * SAMPLES * buckets // sources)
    sample = rows.mapInArrow(_sampled(min(size, 16 * SAMPLES)), "a long, b long, weight double").toArrow()
    a, b = (sample.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (0, 1))
    weight = sample.column(2).to_numpy()
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b, reached = a[order], b[order], np.cumsum(weight[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, buckets) / buckets)
    a, b = a[at], b[at]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(TaskContext.get().partitionId())
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for block in _blocks(batches):
            count = len(block.starts)
            if count:
                at = random.integers(0, count, 64)
                found.append((*block.order_keys(at), np.full(64, count / 64)))
            if len(found) > 4 * size:
                found = [_thinned(found, size, random)]
        if found:
            a, b, weight = _thinned(found, size, random)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(weight)], ["a", "b", "weight"])

    return run


def _thinned(found, size: int, random) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(a) <= size:
        return a, b, weight
    total = weight.sum()
    at = random.choice(len(a), size, p=weight / total)
    return a[at], b[at], np.full(size, total / size)


def _starts_in(a: np.ndarray, b: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index in the sorted keys (a, b) from which each bound holds."""
    low = np.searchsorted(a, bounds[0], "left")
    high = np.searchsorted(a, bounds[0], "right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(b[low[i] : high[i]], bounds[1][i], "left")
    return low


# ------------------------------------------------------------------- sorted runs


def _sorted_runs(bounds: tuple[np.ndarray, np.ndarray]):
    """Sorted distinct suffixes of a block, a row per bucket. A suffix repeats no
    word that it shares with the one before: ``shape`` holds eight times the
    shared words plus all words of each, ``words`` the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            if not len(block.starts):
                continue
            at = np.arange(len(block.starts))
            a, b = block.order_keys(at)
            order = np.lexsort((b, a))
            at, a, b = at[order], a[order], b[order]
            left = block.left[at]
            same = np.zeros(len(at), np.int64)
            alike = np.ones(len(at) - 1, bool)
            for depth in range(DEPTH):
                words = block.words(at, depth)
                alike &= (words[1:] == words[:-1]) & (words[1:] != 0)
                same[1:] += alike
            fresh = np.ones(len(at), bool)
            fresh[1:] = (same[1:] != left[1:]) | (left[1:] != left[:-1])
            firsts = np.flatnonzero(fresh)
            counts = np.diff(np.append(firsts, len(at)))
            cuts = np.searchsorted(firsts, _starts_in(a, b, bounds))
            at, left, same = at[firsts], left[firsts], same[firsts]
            opens = np.concatenate([[0], cuts, [len(at)]])
            same[opens[:-1][opens[:-1] < len(at)]] = 0
            fewer = left - same
            begins = np.append(0, np.cumsum(fewer))
            text, places = block.text(np.arange(begins[-1]) + np.repeat(at + same - begins[:-1], fewer))
            places = places[begins]
            shape, counts = (8 * same + left).astype(np.uint8), counts.astype("<u4")
            lang_of = block.lang_of[at].astype("<u2")
            used = np.flatnonzero(np.diff(opens))
            spans = [(opens[i], opens[i + 1]) for i in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array([block.langs] * len(used), pa.list_(pa.string())),
                    pa.array([lang_of[i:j].tobytes() for i, j in spans], pa.binary()),
                    pa.array([text[places[i] : places[j]].tobytes() for i, j in spans], pa.binary()),
                    pa.array([shape[i:j].tobytes() for i, j in spans], pa.binary()),
                    pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary()),
                ],
                [part.split()[0] for part in RUNS.split(", ")],
            )

    return run


# --------------------------------------------------------------------- counting


def _counted(bounds: tuple[np.ndarray, np.ndarray], least: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        found = Bucket(row for batch in group.to_batches() for row in batch.to_pylist())
        border = found.at_bounds(bounds, bucket)
        rows = found.totals()
        rows += found.phrases(*_border_counts(found, border))
        heads, depths, weights = multikey_quicksort(found.keys, found.weights, least)
        inner = ~border[depths - 1, heads]
        rows += found.phrases(heads[inner], depths[inner], weights[inner])
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "k", "phrase", "f"])

    return run


class Bucket:
    """All suffixes of a bucket: the hash of the word at each depth (0 past the
    end), the number of occurrences, and where the words' texts are."""

    def __init__(self, runs: Iterable[dict]):
        keys, places, self.weights, self.langs, self.texts = [], [], [], [], []
        for run in runs:
            column = pa.array([run["words"]], pa.binary())
            buffer, offsets = text_buffer(column)
            space = np.flatnonzero(buffer == 32)
            starts = np.append(0, space + 1)[:-1]
            hashes = _word_hashes(buffer, starts, space, _CODES)
            lang_of = np.frombuffer(run["lang_of"], "<u2")
            shape = np.frombuffer(run["shape"], np.uint8).astype(np.int32)
            same, left = shape >> 3, shape & 7
            begins = np.cumsum(left - same) - (left - same)
            rows = np.arange(len(shape))
            words = np.full((DEPTH, len(shape)), -1, np.int32)
            for depth in range(DEPTH):
                # the word is that of the last suffix that did not share it
                own = np.maximum.accumulate(np.where(same <= depth, rows, 0))
                held = left > depth
                words[depth, held] = (begins[own] + depth - same[own])[held]
            held = words >= 0
            named = np.zeros(words.shape, np.uint64)
            named[held] = _in_lang(hashes[words[held]], run["langs"], np.broadcast_to(lang_of, words.shape)[held])
            keys.append(named)
            places.append(words)
            self.weights.append(np.frombuffer(run["counts"], "<u4").astype(np.int64))
            self.langs.append((run["langs"], lang_of))
            self.texts.append((run["words"], starts, space))
        self.sizes = np.array([len(w) for w in self.weights])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.keys, self.places = np.concatenate(keys, axis=1), np.concatenate(places, axis=1)
        self.weights = np.concatenate(self.weights)

    def totals(self) -> list[tuple[str, int, str, int]]:
        out = []
        for (langs, lang_of), start, size in zip(self.langs, self.starts, self.sizes, strict=True):
            sums = np.bincount(lang_of, self.weights[start : start + size], len(langs)).astype(np.int64)
            out += [(lang, 0, "", n) for lang, n in zip(langs, sums.tolist(), strict=True) if n]
        return out

    def phrases(self, heads: np.ndarray, depths: np.ndarray, weights: np.ndarray) -> list[tuple[str, int, str, int]]:
        """Language, length, text and count of the phrases that the suffixes
        ``heads`` begin with."""
        out = []
        runs = np.searchsorted(self.starts, heads, "right") - 1
        for head, run, depth, weight in zip(heads.tolist(), runs.tolist(), depths.tolist(), weights.tolist(), strict=True):
            (langs, lang_of), (text, starts, ends) = self.langs[run], self.texts[run]
            words = (text[starts[w] : ends[w]] for w in self.places[:depth, head])
            out.append((langs[lang_of[head - self.starts[run]]], depth, b" ".join(words).decode("utf-8"), weight))
        return out

    def at_bounds(self, bounds: tuple[np.ndarray, np.ndarray], bucket: int) -> np.ndarray:
        """For each depth, whether the suffix's words up to it are also the
        words of a bound, so that their phrase may go on in another bucket."""
        halves = [self.keys[d] >> U(32) for d in range(DEPTH)]
        out = np.zeros(self.keys.shape, bool)
        for i in (bucket - 1, bucket):
            if 0 <= i < len(bounds[0]):
                a, b = bounds[0][i], bounds[1][i]
                match = np.ones(self.keys.shape[1], bool)
                for depth, half in enumerate((a >> U(32), a & U(0xFFFFFFFF), b >> U(32), b & U(0xFFFFFFFF))):
                    match &= halves[depth] == half
                    out[depth] |= match & (self.keys[depth] != 0)
        return out


def _border_counts(found: Bucket, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, depths, weights = [], [], []
    for depth in range(DEPTH):
        rows = np.flatnonzero(border[depth])
        if len(rows):
            _, first, inverse = np.unique(found.keys[: depth + 1, rows], axis=1, return_index=True, return_inverse=True)
            heads.append(rows[first])
            depths.append(np.full(len(first), depth + 1))
            weights.append(np.bincount(inverse.reshape(-1), found.weights[rows]).astype(np.int64))
    if not heads:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(heads), np.concatenate(depths), np.concatenate(weights)


def multikey_quicksort(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pointer, depth and weight of every partition of at least ``least``
    equal prefixes. ``keys[d, i]`` is what suffix i has at depth d, 0 past its
    end. All open partitions are split in one step, each three ways around its
    own pivot."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depths = np.zeros(1, np.int64)
    pointers, lengths = np.arange(keys.shape[1], dtype=np.int32), np.array([keys.shape[1]])
    if keys.shape[1] == 0 or weights.sum() < least:
        pointers, lengths, depths = pointers[:0], lengths[:0], depths[:0]
    while len(lengths):
        begins = np.cumsum(lengths) - lengths
        own = keys[np.repeat(depths, lengths), pointers]
        ends = begins + lengths - 1
        low, mid, high = own[begins], own[begins + lengths // 2], own[ends]
        pivots = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))
        pivot = np.repeat(pivots, lengths)
        less, equal = own < pivot, own == pivot
        sides = []
        for side, mask in enumerate((less, equal, ~(less | equal))):
            sizes = np.add.reduceat(mask, begins, dtype=np.int64)
            some = sizes > 0
            mine, sizes, at = pointers[mask], sizes[some], depths[some]
            if not len(sizes):
                continue
            first = np.cumsum(sizes) - sizes
            weight = np.add.reduceat(weights[mine], first)
            stay = weight >= least
            if side == 1:
                stay &= pivots[some] != 0
                found.append((mine[first[stay]], at[stay] + 1, weight[stay]))
                stay &= at + 1 < keys.shape[0]
                at = at + 1
            sides.append((mine[np.repeat(stay, sizes)], sizes[stay], at[stay]))
        pointers, lengths, depths = (np.concatenate(x) for x in zip(*sides, strict=True))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
