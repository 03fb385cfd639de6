import os
import shutil

from pyspark.sql import functions as F

from veilscan.sources.eventlog import read_events
from veilscan.streaming.stream import Progress, event_sink, finish, read_file_stream, scan_stream, tail_events


def test_files_to_events_to_alerts(spark, tmp_path):
    inbox, log, alerts = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "alerts")
    os.makedirs(inbox)
    seen = []
    listener = Progress(lambda documents, findings: seen.append((documents, findings)))
    spark.streams.addListener(listener)
    (inbox / "a.txt").write_text("PHONE 412-823-0629  FAX 412-823-8314")

    def run():
        found = scan_stream(read_file_stream(spark, str(inbox)))
        event_sink(found, F.lit("h1"), log, str(tmp_path / "cp"), available_now=True).awaitTermination()

    run()
    (inbox / "b.txt").write_text("clean")
    (inbox / "c.txt").write_text("ssn 219-09-9999")
    run()
    written = read_events(spark, log)
    assert sorted((r["file_name"], r["context"]) for r in written.collect()) == [
        ("a.txt", "PHONE ***-***-0629  FAX ***-***-8314"), ("a.txt", "PHONE ***-***-0629  FAX ***-***-8314"),
        ("c.txt", "ssn ***-**-9999")]
    coverage = spark.createDataFrame([("a.txt", "scanned"), ("s.pdf", "needs_ocr")], "path string, status string")
    ends = {"run": "r1", "roots": [str(inbox)], "duration": "1s"}
    assert finish(written, coverage, F.lit("h1"), log, **ends)
    assert not finish(written, coverage, F.lit("h1"), log, **ends)  # a retry
    kinds = {r["event"]: r["count"] for r in read_events(spark, log).groupBy("event").count().collect()}
    assert kinds == {"finding": 3, "needs_ocr": 1, "scan_summary": 1}

    query = (
        tail_events(spark, log).select("event", "rule_id", "level").writeStream.format("parquet").option("path", alerts)
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    raised = sorted((r["rule_id"], r["level"]) for r in spark.read.parquet(alerts).collect())
    assert raised == [(100951, 10), (100951, 10), (100953, 12), (100955, 5), (100956, 3)]
    spark.streams.removeListener(listener)
    assert seen[-1] == (3, 3)
    assert listener.categories == {"Phone Number": 2, "SSN": 1}


def test_interrupted_finish(spark, tmp_path):
    log = str(tmp_path / "log")
    found = spark.createDataFrame([("a", "SSN")], "path string, category string")
    coverage = spark.createDataFrame([(f"{n}.pdf", "needs_ocr") for n in range(3)], "path string, status string")
    ends = {"run": "r2", "roots": ["/d"], "duration": "1s"}
    # a call that was stopped between its two steps, and one within the second
    assert finish(found, coverage, F.lit("h1"), log, **ends)
    shutil.rmtree(f"{log}/finish-r2")
    assert finish(found, coverage, F.lit("h1"), log, **ends)
    shutil.rmtree(f"{log}/finish-r2")
    os.makedirs(f"{log}/finish-r2/_temporary/0")
    assert finish(found, coverage, F.lit("h1"), log, **ends)
    assert not finish(found, coverage, F.lit("h1"), log, **ends)
    assert finish(found, coverage, F.lit("h1"), log, **ends | {"run": "r3"})
    kinds = {r["event"]: r["count"] for r in read_events(spark, log).groupBy("event").count().collect()}
    assert kinds == {"needs_ocr": 6, "scan_summary": 2}


def test_batch_equals_stream_expression(spark):
    docs = spark.createDataFrame([("a", "ssn 219-09-9999 j@x.org"), ("b", "none")], "path string, content string")
    rows = scan_stream(docs, masked=False).select("path", "match").collect()
    assert sorted(map(tuple, rows)) == [("a", "219-09-9999"), ("a", "j@x.org")]


def test_stream_hides_secrets(spark):
    text = "site,user,password\na.example,jo@x.org,hunter2-secret\n"
    docs = spark.createDataFrame([("x/export.csv", text), ("x/export.txt", text)], "path string, content string")
    shown = {r["path"]: r["context"] for r in scan_stream(docs).collect()}
    assert shown["x/export.csv"] == "a.example,j*@x.org,********"
    assert "hunter2-secret" in shown["x/export.txt"]
