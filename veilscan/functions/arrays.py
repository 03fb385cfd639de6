"""Small building blocks over Spark's higher-order array functions."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``. An aggregate over nothing
    returns what ``body`` gives as it is, where ``transform`` would copy it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def running_states(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each element of ``items``, left to right.

    ``aggregate`` can only grow its result by copying it, so the items are
    walked in chunks: a growing array is never longer than one chunk (or the
    number of chunks), and the work stays close to linear on long arrays.
    """

    def last(array: Column) -> Column:
        return F.element_at(array, -1)

    def tail(array: Column, count: Column) -> Column:
        # its size is known: taking it of the array would compute that twice
        return F.slice(array, F.lit(2), count)

    def walk(chunk: Column, carry: Column) -> Column:
        return F.aggregate(
            chunk,
            F.array(carry),
            lambda states, item: F.array_append(states, step(last(states), item)),
        )

    def chunked(values: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(values), F.lit(_CHUNK))
        walked = F.aggregate(
            firsts,
            F.array(F.array(zero)),
            lambda done, first: F.array_append(done, walk(F.slice(values, first, F.lit(_CHUNK)), last(last(done)))),
        )
        return F.flatten(
            F.transform(tail(walked, F.size(firsts)), lambda states: tail(states, F.size(states)))
        )

    return let(
        items,
        lambda values: F.when(F.size(values) > _CHUNK, chunked(values)).otherwise(tail(walk(values, zero), F.size(values))),
    )


def slots(counted: DataFrame, size: int) -> Column:
    """A scalar array of ``size`` longs from rows (slot, n), zero elsewhere. It
    stays outside of lambda functions, in which Spark allows no subquery."""
    filled = counted.sparkSession.range(size).withColumnRenamed("id", "slot").join(counted, "slot", "left")
    entry = F.struct("slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["n"])).scalar()


def bits_of(hashed: DataFrame, words: int) -> Column:
    """A scalar bitmap of ``64 * words`` bits as longs, with a bit set for every
    hash in the table's only column."""
    bit = F.pmod(F.col(hashed.columns[0]), F.lit(64 * words))
    marked = hashed.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return slots(marked.agg(F.bit_or(one).alias("n")), words)


def has_bit(bitmap: Column, hashed: Column, words: int) -> Column:
    """True for every hash whose bit is set; by chance for others."""
    bit = F.pmod(hashed, F.lit(64 * words))
    return F.call_function("getbit", F.get(bitmap, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1
