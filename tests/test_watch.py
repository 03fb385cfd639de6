"""Event time: hourly findings and silent hosts, batch by batch."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veilscan.operators.rollup import last_scan, silent_hosts
from veilscan.streaming.watch import finding_rates, silence_alerts

EVENT = "event string, host string, timestamp string, category string"
START = datetime(2026, 7, 1, tzinfo=timezone.utc)


def at(hours, event="scan_summary", host="h1", category=None):
    return event, host, (START + timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ"), category


class Log:
    """A log that grows by a file per batch, and a query that is started anew
    for each, from its checkpoint."""

    def __init__(self, spark, folder, operator, mode="append"):
        self.spark, self.folder, self.operator, self.mode, self.batches, self.out = spark, str(folder), operator, mode, 0, []
        os.makedirs(f"{self.folder}/log")

    def add(self, *events):
        self.batches += 1
        rows = self.spark.createDataFrame(events, EVENT)
        rows.coalesce(1).write.mode("append").json(f"{self.folder}/log/{self.batches:03d}")
        stream = self.spark.readStream.schema(EVENT).json(f"{self.folder}/log/*")
        new = []
        query = (
            self.operator(stream).writeStream.outputMode(self.mode)
            .foreachBatch(lambda batch, _: new.extend(batch.collect()))
            .option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.progress = query.lastProgress
        self.out += new
        return new


@pytest.fixture()
def utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_silent_hosts(spark, tmp_path, utc):
    log = Log(spark, tmp_path, lambda events: silence_alerts(events, days=9, late="1 hour"))

    def told(rows):
        return sorted((r["host"], round((r["last_scan"].replace(tzinfo=timezone.utc) - START).total_seconds() / 3600, 2)) for r in rows)

    day = 24
    assert log.add(at(0), at(2, host="h2"), at(1, host="h2")) == []
    assert log.add(at(9 * day, "finding", "h9", "SSN")) == []  # the watermark is an hour behind
    assert told(log.add(at(9 * day + 1.5, "finding", "h9", "SSN"))) == [("h1", 0)]
    assert log.add(at(9 * day + 2, "finding", "h9", "SSN")) == []  # told once
    # out of order, but not too late: h2 stays quiet until its newest summary is old
    assert log.add(at(9 * day + 1.6, host="h2"), at(9 * day + 1.2, host="h2"), at(9 * day + 4, "finding", "h9", "SSN")) == []
    assert told(log.add(at(10 * day, host="h1"), at(12 * day, "finding", "h9", "SSN"))) == []
    # a summary behind the watermark is dropped
    assert log.add(at(9 * day, host="h3")) == []
    assert told(log.add(at(30 * day, "finding", "h9", "SSN"))) == [("h1", 240), ("h2", 217.6)]
    assert log.add(at(60 * day, "finding", "h9", "SSN")) == []
    # the batch query over the same log agrees
    events = spark.read.schema(EVENT).json(f"{tmp_path}/log/*").where("host <> 'h3'").withColumn("timestamp", F.to_timestamp("timestamp"))
    hosts = events.where("event = 'scan_summary'").select("host").distinct()
    now = F.lit(START + timedelta(days=60))
    assert {r["host"] for r in silent_hosts(hosts, events, now).collect()} == {"h1", "h2"}


def test_newest_summary_of_a_stream(spark, tmp_path, utc):
    log = Log(spark, tmp_path, lambda events: last_scan(events).select("host", "timestamp"), mode="update")
    log.add(at(5), at(3), at(4, host="h2"))
    assert {tuple(r) for r in log.add(at(1), at(7, host="h2"))} == {("h1", at(5)[2]), ("h2", at(7)[2])}


def test_finding_rates(spark, tmp_path, utc):
    log = Log(spark, tmp_path, lambda events: finding_rates(events, "1 hour", "10 minutes"))

    def counted(rows):
        return sorted((r["window_start"].hour, r["category"], r["findings"]) for r in rows)

    finding = {"event": "finding"}
    assert log.add(at(0.1, category="SSN", **finding), at(0.5, category="SSN", **finding), at(0.9, category="Email Address", **finding), at(0.95)) == []
    # open: the watermark is at 0:57
    assert log.add(at(1.1, category="SSN", **finding), at(0.2, category="SSN", **finding)) == []
    assert counted(log.add(at(1.2))) == [(0, "Email Address", 1), (0, "SSN", 3)]
    assert counted(log.add(at(0.3, category="SSN", **finding), at(1.05, category="SSN", **finding))) == []  # the first is too late
    assert counted(log.add(at(9, category="SSN", **finding))) == [(1, "SSN", 2)]
    for hour in range(10, 20):
        log.add(*(at(hour + n / 100, category=c, **finding) for n in range(9) for c in ("SSN", "Phone Number")))
        # open windows only: two hours of two categories at most
        assert log.progress["stateOperators"][0]["numRowsTotal"] <= 4
    assert counted(r for r in log.out if r["window_start"].hour == 15) == [(15, "Phone Number", 9), (15, "SSN", 9)]
