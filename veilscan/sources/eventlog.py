"""The append-only log of events (JSON lines), in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.operators.events import DEFAULT_FORMAT, EventFormat
from veilscan.schema import EVENTS


def parsed_event(line: Column, fmt: EventFormat = DEFAULT_FORMAT) -> Column:
    """One JSON line as a struct; its fields are read with :func:`event_fields`."""
    keys = dict.fromkeys((fmt.event_key, "event_type"))
    body = [f for f in EVENTS if f.name != "event"]
    return F.from_json(line, T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *body]))


def event_fields(parsed: str, fmt: EventFormat = DEFAULT_FORMAT) -> dict[str, Column]:
    """The columns of :data:`veilscan.schema.EVENTS` in the column ``parsed``.
    Old writers called the event-type key ``event_type``; it is read where the
    current one is absent."""
    keys = dict.fromkeys((fmt.event_key, "event_type"))
    event = F.coalesce(*[F.col(f"{parsed}.{k}") for k in keys])
    return {f.name: event if f.name == "event" else F.col(f"{parsed}.{f.name}") for f in EVENTS}


def from_lines(lines: DataFrame, fmt: EventFormat = DEFAULT_FORMAT, keep: Sequence[str] = ()) -> DataFrame:
    """Events from a ``value`` column of JSON lines."""
    parsed = lines.select(parsed_event(F.col("value"), fmt).alias("e"), *keep)
    return parsed.where(F.col("e").isNotNull()).select(
        *[column.alias(name) for name, column in event_fields("e", fmt).items()],
        *keep,
    )


def read_events(spark: SparkSession, path: str, fmt: EventFormat = DEFAULT_FORMAT) -> DataFrame:
    """All events of a log, in its folder or in folders below it."""
    return from_lines(spark.read.option("recursiveFileLookup", True).text(path), fmt)


def only_findings(events: DataFrame) -> DataFrame:
    """Gap and summary events must not enter any grouping of findings."""
    return events.where(F.col("event") == "finding")
