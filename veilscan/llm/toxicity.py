"""Toxicity scores by a factorization machine over hashed terms.

Every distinct term of a text is a feature, hashed into a table of fixed size.
Besides a weight per feature the model has a short vector per feature; the
product of two vectors weighs the pair, so that an insult next to the mention
of a group can count for more than both alone. Terms get vectors if they tell
the labels apart by their own counts over all labelled rows; pairs of other
terms are let in as features of their own, by the counts of the pair. The model
is trained here, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.arrays import bits_of, has_bit
from veilscan.llm.common import give_back, keep, prepare
from veilscan.llm.hashing import U, Words

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 10_000
#: Their terms, at most; with longer texts fewer rows are drawn.
TRAIN_TERMS = 40_000_000
FEATURE_BITS = 18
FACTORS = 4
#: Longs of the bitmap of labelled ids, whatever their number: 2 MB.
ID_WORDS = 1 << 18
#: Bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: Terms get a weight if they are in so many labelled texts and their share of
#: toxic ones is so many standard errors from the average; at most this many.
MIN_TEXTS = 5
MIN_ERRORS = 3.0
MOST_TERMS = 8192
#: Pairs get a weight if they are in so many toxic training texts and so many
#: standard errors above what both terms' own shares explain; at most this many,
#: of the terms that are in most of up to PAIR_TEXTS toxic texts.
MIN_PAIR_TEXTS = 8
MIN_PAIR_ERRORS = 8.0
MOST_PAIRS = 2048
PAIR_TERMS = 6144
PAIR_TEXTS = 2000
EPOCHS = 10
BATCH = 64
THRESHOLD = 0.3


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    #: Two terms for each pair that is a feature; they are numbered after the terms.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))

    def logits(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of texts whose distinct terms lie at rows[i]:rows[i + 1]."""
        return self.sums(*self.with_pairs(features, rows))

    def with_pairs(self, features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' terms and the pairs they hold, and the bounds of the rows."""
        if not len(self.pairs):
            return features, rows
        there, out = np.zeros(1 << FEATURE_BITS, bool), []
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            own = features[a:b]
            there[own] = True
            held = np.flatnonzero(there[self.pairs[:, 0]] & there[self.pairs[:, 1]])
            there[own] = False
            out.append(np.concatenate((own, held + (1 << FEATURE_BITS))))
        sizes = np.cumsum([len(x) for x in out], dtype=np.int64)
        return np.concatenate(out) if out else features, np.concatenate(([0], sizes))

    def sums(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        linear = _segments(self.weight[features], rows)
        vectors = self.factors[features]
        total = _segments(vectors, rows)
        squares = _segments((vectors * vectors).sum(axis=1), rows)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)


def held_out(id_col: str):
    """Rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that are not held out: terms are chosen
    by their counts over all of them, weights fitted on a sample of at most
    ``rows`` drawn by a hash of the id. Texts are shuffled to their labels; a
    bitmap of the labelled ids keeps the others where they are (all but a few
    by chance, more beyond some million labels). Rows with a null id, label or text are
    left out; an id with several labels counts once for each. Without labels of
    both kinds the model is the share of label 1 (none: 0)."""
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id")).withColumn("draw", F.xxhash64("id"))
    last = known.select("draw").orderBy("draw").limit(rows).agg(F.max("draw")).first()[0]
    if last is None:
        return train([], np.zeros(0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    labelled = bits_of(known.select(F.xxhash64(F.col("id").cast("string")).alias("hashed")), ID_WORDS)
    texts = texts.where(~held_out("id") & has_bit(labelled, F.xxhash64(F.col("id").cast("string")), ID_WORDS))
    texts = texts.join(known, "id").select("draw", "label", "text")
    seen = keep(texts.mapInArrow(_counted(last), "term int, texts long, toxic long, draw long, label int, features binary"))
    counts = seen.where("term is not null").groupBy("term").agg(F.sum("texts"), F.sum("toxic")).toArrow()
    everywhere, toxic = (np.zeros(1 << FEATURE_BITS, np.int64) for _ in range(2))
    terms = counts[0].to_numpy()
    everywhere[terms], toxic[terms] = counts[1].to_numpy(), counts[2].to_numpy()
    frequent = spark.sparkContext.broadcast(everywhere >= MIN_TEXTS)
    drawn = keep(seen.where("features is not null").select("draw", "label", "features").mapInArrow(_frequent(frequent), "draw long, label int, features binary"))
    # a total order, so that reruns train alike
    drawn = drawn.orderBy("draw", "label", "features")
    count, size = drawn.agg(F.count("*"), F.sum(F.length("features")) / 4).first()
    most = rows if not size or size <= TRAIN_TERMS else min(rows, int(count * TRAIN_TERMS / size))
    sample = drawn.limit(most).select("label", "features").toArrow()
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["features"]]
    model = train(found, sample["label"].to_numpy().astype(float), counts=(everywhere, toxic))
    # the driver goes on to other work: what the sample took is given back
    del sample, found, counts
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int, 1 where the score
    reaches ``threshold``). Only the text, read whole, decides; a null or empty
    text gets the score of no terms. Input columns named score or predicted are
    replaced, others are kept, repeated rows too."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in ("score", "predicted") if c not in (id_col, text_col)])
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*inner.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return inner.mapInArrow(_scored(shared, columns.index(text_col), threshold), schema).toDF(*columns, "score", "predicted")


# --- features ---------------------------------------------------------------


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, whole words and their beginnings
    (which stand for inflected forms), and the n+1 bounds of the rows."""
    words = Words(column, lower=True, terms=True)
    kinds = [words.hashes, *(words.beginnings(size) for size in BEGINNINGS)]
    hashed = np.stack([(x >> U(64 - FEATURE_BITS)).astype(np.int32) for x in kinds], axis=1)
    found = [np.unique(hashed[a:b]) for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]
    rows = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
    return np.concatenate(found) if found else hashed[:0], rows


def _counted(last: int):
    """For each term how many texts and toxic texts of the task hold it, and the
    terms of the texts that are drawn for training."""
    names = ["term", "texts", "toxic", "draw", "label", "features"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def row(values: dict, length: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values[n].cast(k) if n in values else pa.nulls(length, k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere, toxic = (np.zeros(1 << FEATURE_BITS, np.int64) for _ in range(2))
        for batch in batches:
            found, rows = features(batch.column(2))
            everywhere += np.bincount(found, minlength=len(everywhere))
            marked = np.repeat(batch.column(1).to_numpy() != 0, np.diff(rows))
            toxic += np.bincount(found[marked], minlength=len(toxic))
            drawn = np.flatnonzero(batch.column(0).to_numpy() <= last)
            own = pa.array([found[rows[i] : rows[i + 1]].astype(np.int32).tobytes() for i in drawn], pa.binary())
            yield row({"draw": batch.column(0).take(pa.array(drawn)), "label": batch.column(1).take(pa.array(drawn)), "features": own}, len(drawn))
        terms = np.flatnonzero(everywhere)
        yield row({"term": pa.array(terms), "texts": pa.array(everywhere[terms]), "toxic": pa.array(toxic[terms])}, len(terms))

    return run


def _frequent(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
            left = pa.array([x[shared.value[x]].tobytes() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), left], ["draw", "label", "features"])

    return run


def _segments(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values over rows[i]:rows[i + 1]; empty rows give 0."""
    out = np.zeros((len(rows) - 1, *values.shape[1:]))
    full = np.flatnonzero(rows[1:] > rows[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, rows[:-1][full], axis=0)
    return out


def _scored(shared, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        used = model.weight[: 1 << FEATURE_BITS] != 0
        used[model.pairs.ravel()] = True
        for batch in batches:
            found, rows = features(batch.column(text_at))
            live = used[found]
            rows = np.concatenate(([0], np.cumsum(live)))[rows]
            values = _sigmoid(model.logits(found[live], rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


# --- training ---------------------------------------------------------------


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Stochastic gradient steps with a rate per parameter that falls with its
    past gradients. ``counts`` are the texts and toxic texts of each term where
    these are more than the ones trained on."""
    random = np.random.Generator(np.random.PCG64(seed))
    share = float(labels.mean()) if len(labels) else 0.0
    here = term_counts(texts, labels)
    everywhere, toxic = counts or here
    seen = telling(everywhere, toxic)
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    mixed = 0 < share < 1
    pairs = telling_pairs(texts, labels, seen) if mixed else np.zeros((0, 2), np.int32)
    size = (1 << FEATURE_BITS) + len(pairs)
    model = Model(bias, np.zeros(size), np.zeros((size, FACTORS)), pairs)
    if not mixed:
        return model
    kept = seen.copy()
    kept[pairs.ravel()] = True
    texts = [model.with_pairs(x[kept[x]], np.array([0, int(kept[x].sum())]))[0] for x in texts]
    learnt = np.concatenate((seen, np.ones(len(pairs), bool)))
    texts = [x[learnt[x]] for x in texts]
    model.factors[: len(seen)][seen] = random.normal(0, 0.001, (int(seen.sum()), FACTORS))
    # what the sample hardly holds starts from its counts; a word is several terms
    rare = seen & (here[0] < MIN_TEXTS)
    odds = np.log((toxic[rare] + share) / (everywhere[rare] - toxic[rare] + 1 - share)) - bias
    model.weight[: len(seen)][rare] = odds / (1 + len(BEGINNINGS))
    past_weight, past_factors = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            at = order[first : first + BATCH]
            rows = np.concatenate(([0], np.cumsum([len(texts[i]) for i in at])))
            found = np.concatenate([texts[i] for i in at])
            if len(found):
                _learn(model, past_weight, past_factors, found, rows, labels[at])
    return model


def term_counts(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term the texts and the toxic texts that hold it."""
    everywhere, toxic = (np.zeros(1 << FEATURE_BITS, np.int64) for _ in range(2))
    for text, label in zip(texts, labels, strict=True):  # a text's terms are distinct
        everywhere[text] += 1
        if label:
            toxic[text] += 1
    return everywhere, toxic


def telling(everywhere: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Marks the terms that occur with one label more than chance explains."""
    share = toxic.sum() / max(1, everywhere.sum())
    errors = np.abs(toxic - share * everywhere) / np.sqrt(share * (1 - share) * everywhere + 1e-9)
    errors[everywhere < MIN_TEXTS] = 0
    floor = max(MIN_ERRORS, np.partition(errors, -MOST_TERMS)[-MOST_TERMS])
    return errors >= floor


def telling_pairs(texts: list[np.ndarray], labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Pairs of terms, not both of them ``seen``, that are toxic together more
    than chance and their own shares explain. Equal texts count once. Pairs are
    looked for in as many clean texts as toxic ones, then counted in all."""
    first = {(hashlib.sha256(x.tobytes()).digest(), y): i for i, (x, y) in reversed(list(enumerate(zip(texts, labels != 0, strict=True))))}
    at = np.array(sorted(first.values()))
    marked = labels[at] != 0
    everywhere, toxic = term_counts([texts[i] for i in at], marked)
    terms = np.argsort(-toxic, kind="stable")[:PAIR_TERMS]
    terms = np.sort(terms[toxic[terms] >= MIN_PAIR_TEXTS])
    bad, good = at[marked][:PAIR_TEXTS], at[~marked][:PAIR_TEXTS]
    if len(terms) < 2 or not len(good):
        return np.zeros((0, 2), np.int32)
    place = np.full(1 << FEATURE_BITS, -1)
    place[terms] = np.arange(len(terms))

    def table(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(terms)), np.float32)
        for n, i in enumerate(rows):
            own = place[texts[i]]
            out[n, own[own >= 0]] = 1
        return out

    share = marked.mean()
    odds = np.log((toxic[terms] + share) / (everywhere[terms] - toxic[terms] + 1 - share)) - np.log(share / (1 - share))
    more_bad, more_good = marked.sum() / len(bad), (~marked).sum() / len(good)
    toxics, cleans, weak = table(bad), table(good), ~seen[terms]
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(terms), 128):
        part = slice(low, low + 128)
        both, clean = toxics[:, part].T @ toxics[:, low:], cleans[:, part].T @ cleans[:, low:]
        errors = _pair_errors(both * more_bad, (both * more_bad + clean * more_good), odds[part, None] + odds[None, low:], share)
        fit = (both * more_bad >= MIN_PAIR_TEXTS) & (errors >= MIN_PAIR_ERRORS / 2) & (weak[part, None] | weak[None, low:])
        a, b = np.nonzero(np.triu(fit, 1))
        best = np.argsort(-errors[a, b], kind="stable")[: 4 * MOST_PAIRS]
        found.append((a[best] + low, b[best] + low, errors[a[best], b[best]]))
    a, b, errors = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.argsort(-errors, kind="stable")[: 4 * MOST_PAIRS]
    a, b = a[best], b[best]
    del toxics, cleans
    both, clean = (np.zeros(len(a)) for _ in range(2))
    there = np.zeros(len(terms) + 1, bool)  # the last for terms without a place
    for i, bad_one in zip(at, marked, strict=True):
        own = place[texts[i]]
        there[own] = True
        there[-1] = False
        (both if bad_one else clean)[there[a] & there[b]] += 1
        there[own] = False
    errors = _pair_errors(both, both + clean, odds[a] + odds[b], share)
    chosen = np.argsort(-errors, kind="stable")[:MOST_PAIRS]
    chosen = chosen[(errors[chosen] >= MIN_PAIR_ERRORS) & (both[chosen] >= MIN_PAIR_TEXTS)]
    return np.stack((terms[a[chosen]], terms[b[chosen]]), axis=1).astype(np.int32)


def _pair_errors(both, count, odds, share: float) -> np.ndarray:
    """Standard errors of a pair's toxic texts above the number that the odds
    of its terms, or chance, explain."""
    expected = np.clip(_sigmoid(odds + np.log(share / (1 - share))), share, 1 - 1e-3)
    return ((both - count * expected) / np.sqrt(count * expected * (1 - expected) + 1e-9)).astype(np.float32)


def _learn(model: Model, past_weight, past_factors, found, rows, labels, rate=0.1, decay=2e-3) -> None:
    error = (_sigmoid(model.sums(found, rows)) - labels) / len(labels)
    model.bias -= 0.05 * float(error.sum())
    owner = np.repeat(np.arange(len(labels)), np.diff(rows))
    vectors = model.factors[found]
    total = _segments(vectors, rows)
    slope = error[owner]
    ids, spot = np.unique(found, return_inverse=True)
    by_weight = np.bincount(spot, slope, len(ids)) + decay * model.weight[ids] / len(labels)
    past_weight[ids] += by_weight**2
    model.weight[ids] -= rate * by_weight / np.sqrt(past_weight[ids])
    by_factor = slope[:, None] * (total[owner] - vectors)
    gradient = np.stack([np.bincount(spot, by_factor[:, f], len(ids)) for f in range(FACTORS)], axis=1)
    gradient += decay * model.factors[ids] / len(labels)
    past_factors[ids] += gradient**2
    model.factors[ids] -= 0.2 * rate * gradient / np.sqrt(past_factors[ids])
