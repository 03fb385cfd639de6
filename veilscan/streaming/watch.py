"""What an event stream tells as time passes: findings per hour, and hosts that
have fallen silent. Time is event time; what lies further back than the newest
event minus ``late`` is dropped, and no state is kept for it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 24 * 60 * 60 * 1000


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with ``event_time``; the watermark follows all of them."""
    return events.withColumn("event_time", F.to_timestamp("timestamp")).withWatermark("event_time", late)


def _only(event: str) -> Column:
    """A condition that reads the event time too: one that does not would be
    pushed below the watermark, which then followed these events alone."""
    return F.when(F.col("event_time").isNotNull(), F.col("event") == event)


def finding_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings per window of event time and category: window_start, window_end,
    category, findings.

    In a stream a window leaves, once and for good, when the newest event is
    ``late`` beyond its end; only open windows are held. A finding whose window
    has left is dropped, one that is late but whose window is open counts.
    """
    rows = _timed(events, late).where(_only("finding"))
    counted = rows.groupBy(F.window("event_time", window), "category").agg(F.count("*").alias("findings"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "findings"
    )


_STATE = "last timestamp, told boolean"
_ALERT = "host string, last_scan timestamp, silent_since timestamp"


def silence_alerts(events: DataFrame, days: int = 9, late: str = "1 hour") -> DataFrame:
    """A stream of alerts: host, last_scan, silent_since - one when a host's
    newest summary has become more than ``days`` old, and another only if the
    host reports and falls silent again.

    The events of all hosts move the time, so a host is missed even if nothing
    comes from it. Of each host only its newest summary is kept; summaries in
    any order within ``late`` give the same alerts, later ones are dropped. A
    host is known from its first summary on.
    """
    summaries = _timed(events, late).where(_only("scan_summary")).select("host", "event_time")
    return summaries.groupBy("host").applyInPandasWithState(
        _host(days), _ALERT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def _host(days: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        if not state.hasTimedOut:
            for frame in frames:
                newest = frame["event_time"].max()
                if last is None or newest > pd.Timestamp(last):
                    last, told = newest, False
        last = pd.Timestamp(last)
        silent = last + pd.Timedelta(days=days)
        due = int(last.value // 10**6) + days * DAY_MS + 1  # the first millisecond that is more than that
        if not told and (state.hasTimedOut or state.getCurrentWatermarkMs() >= due):
            told = True
            yield pd.DataFrame({"host": [key[0]], "last_scan": [last], "silent_since": [silent]})
        state.update((last.to_pydatetime(), told))
        if not told:
            state.setTimeoutTimestamp(due)

    return run
