"""Mixing sources to target weights by balanced sampling (the cube method).

Each source has a target size; its documents share one inclusion rate, the
target over the source's size. The whole part of the rate is taken as copies,
the rest is a sampling problem with equal fractional probabilities. The flight
phase moves them, two constraints wide (words and documents), through the null
space of the constraints until all but two of a group are 0 or 1; the sums stay
exact. Groups hold a bounded number of documents, and what is left of all
groups is flown again in groups, level by level, until one small landing
problem per source remains: a dozen documents, of which the choice is taken
that comes nearest to their expected totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm.common import WORD, keep, prepare

#: Documents of a group in the flight phase.
GROUP = 4000
#: Documents of a source's landing problem, which tries all choices of them.
LANDING = 13
#: Fractions nearer than this to 0 or 1 count as that.
_EPS = 1e-9

WEIGHTS = (3, 1, 2)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = 150,
    limit: int = 2,
    seed: int = 5,
) -> DataFrame:
    """(doc_id, text_key, size, source, source_size, target, copies, taken), one
    row for each row of ``docs``.

    size counts the words of the text (null: 0). The sources, by code point and
    null last, have the repeating ``weights`` and share ``percent`` of all
    sizes; a target stops at ``limit`` times its source's size and the excess
    goes to the others by weight. copies is 0, 1 or up to ``limit`` whole takings
    of the document, taken = copies * size, and the takings of a source add up
    to its target but for what a dozen whole documents cannot express. Texts without words are
    sampled for the document balance and add nothing. Equal rows are decided
    one by one. Null ids are kept. An empty table gives an empty result. Other
    columns are ignored; reruns agree whatever the partitions.
    """
    prepare(docs.sparkSession)
    sized = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    goals = source_targets(sized, weights, percent, limit)
    # equal rows get numbers, so that each is a unit of its own
    alike = W.partitionBy("doc_id", "source", "text_key", "size").orderBy("size")
    units = sized.withColumn("number", F.row_number().over(alike))
    units = units.join(goals.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal"))).drop("goal")
    units = units.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    units = keep(
        units.select(
            "*",
            F.xxhash64("doc_id", "text_key", "number", "source", F.lit(seed)).alias("draw"),
            F.floor(F.col("rate") + _EPS).alias("whole"),
        ).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    )
    chosen = _sampled(units.where(f"part > {_EPS}").select("source", "draw", "size", "part"))
    out = units.join(chosen.withColumnRenamed("source", "of").withColumnRenamed("draw", "drawn"), F.expr("source <=> of and draw = drawn"), "left")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long")
    return out.select("doc_id", "text_key", "number", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], percent: int, limit: int) -> DataFrame:
    """(source, source_size, target). With sizes s, weights w and a level x,
    target = min(limit * s, x * w); sources reach their limit in the order of
    s / w, so running sums in that order give x. One row per source is sorted."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    out = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    by_limit = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    out = out.withColumn("budget", F.sum("source_size").over(everything) * (percent / 100.0))
    spent = F.coalesce(F.sum("most").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = out.withColumn("level", (F.col("budget") - spent) / left)
    # the first source below its limit sets the level for itself and all behind it
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    target = F.least("most", F.coalesce(free["level"] * F.col("weight"), F.col("most")))
    return out.select("source", "source_size", target.alias("target"))


def _sampled(units: DataFrame) -> DataFrame:
    """(source, draw, extra): the cube method on the fractional ``part`` of
    each unit. Groups are dealt by a hash, so a source with a third of all
    rows is many groups."""
    done = None
    while True:
        per_source = units.groupBy("source").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups"))
        last = units.groupBy("source").count().agg(F.max("count")).head()[0]
        if last is None:
            break
        final = last <= GROUP
        dealt = units.join(per_source.withColumnRenamed("source", "of"), F.expr("source <=> of")).withColumn(
            "slot", F.expr("pmod(xxhash64(draw, 17), groups)")
        )
        flown = keep(
            dealt.select("source", "slot", "draw", "size", "part").groupBy("source", "slot").applyInArrow(_flight(final), FLOWN)
        )
        settled = flown.where("extra is not null").select("source", "draw", "extra")
        done = settled if done is None else done.unionByName(settled)
        if final:
            break
        units = flown.where("extra is null").select("source", "draw", "size", "part")
    if done is None:
        done = units.select("source", "draw", F.lit(0).alias("extra"))
    return done


FLOWN = "source string, draw long, size long, part double, extra int"


def _flight(final: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("draw")
        size = group["size"].to_numpy().astype(float)
        part = balanced(size, group["part"].to_numpy().copy(), final, int(group["draw"][0].as_py()))
        settled = (part == 0) | (part == 1)
        extra = pa.array(part.astype(np.int32), mask=~settled)
        return pa.table([group["source"], group["draw"], group["size"], pa.array(part), extra], names=["source", "draw", "size", "part", "extra"])

    return run


def balanced(size: np.ndarray, part: np.ndarray, final: bool, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but two are 0 or 1, the sums of
    part and of part * size are kept. With ``final`` the flight ends LANDING
    units early and these are settled together."""
    coin = np.random.Generator(np.random.PCG64(abs(seed))).random
    part = np.where(part < _EPS, 0.0, np.where(part > 1 - _EPS, 1.0, part))
    waiting = np.flatnonzero((part > 0) & (part < 1)).tolist()[::-1]
    held: list[int] = []
    while len(held) + len(waiting) > (LANDING if final else 2):
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = (size[i] for i in held)
        way = (b - c, c - a, a - b)  # keeps the number and the words
        _step(part, held, way if any(way) else (1.0, -1.0, 0.0), coin())
        held = [i for i in held if 0 < part[i] < 1]
    if final and (held or waiting):
        _land(size, part, np.array(held + waiting))
    return part


def _land(size: np.ndarray, part: np.ndarray, at: np.ndarray) -> None:
    """Take the choice among the last units that comes nearest to their
    expected words, and then to their expected number."""
    choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    words = np.abs(choices @ size[at] - part[at] @ size[at])
    number = np.abs(choices.sum(axis=1) - part[at].sum())
    part[at] = choices[np.argmin(words + number)]


def _step(part: np.ndarray, held: list[int], way: tuple[float, ...], draw: float) -> None:
    """Move along ``way`` or against it to the first bound, with chances that
    keep every probability's mean."""
    ahead = back = np.inf
    for i, v in zip(held, way, strict=True):
        if v:
            up, down = ((1 - part[i]) / v, part[i] / v) if v > 0 else (part[i] / -v, (1 - part[i]) / -v)
            ahead, back = min(ahead, up), min(back, down)
    move = ahead if draw * (ahead + back) < back else -back
    for i, v in zip(held, way, strict=True):
        x = part[i] + move * v
        part[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
