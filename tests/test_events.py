import json

import pytest
from pyspark.sql import functions as F

from veilscan.operators import alerts, events, rollup
from veilscan.sources.eventlog import from_lines, only_findings, read_events
from veilscan.sources.manifest import ScanSettings, describe_params, load_manifest, merge_settings, params_column
from veilscan.sources.reports import (
    archive_run,
    read_archive,
    csv_rows,
    read_reports,
    report_header,
    scan_history,
    write_report_csv,
    write_report_json,
)



def now():
    return F.expr("timestamp '2026-07-02 09:00:00'")


FINDING = "path string, file_name string, category string, confidence string, line int, match string, context string"
MAIL = FINDING + ", folder string, subject string, `from` string, date string, attachment string"


@pytest.fixture()
def findings(spark):
    row = ("/data/hr/pay=roll.csv", "pay=roll.csv", "SSN", "high", 2, "***-**-9999", "Jane,***-**-9999 a|b\\c")
    return spark.createDataFrame([row], FINDING)


def test_cef(spark, findings):
    line = findings.select(events.to_cef(findings)).first()[0]
    assert line == (
        "CEF:0|example|pii-scan|1.0|ssn|PII detected: SSN|8|filePath=/data/hr/pay\\=roll.csv fname=pay\\=roll.csv "
        "cn1Label=lineNumber cn1=2 cs1Label=category cs1=SSN cs2Label=confidence cs2=high cs3Label=match cs3=***-**-9999 "
        "msg=Jane,***-**-9999 a|b\\\\c"
    )
    framed = findings.select(
        events.syslog_frame(F.lit(line), F.col("confidence"), now(), F.lit("h")).alias("value")
    )
    assert framed.first()[0].startswith("<132>Jul  2 09:00:00 h pii-scan: CEF:0|")
    back = events.parse_cef(framed).first()
    assert back["path"] == "/data/hr/pay=roll.csv" and back["context"] == "Jane,***-**-9999 a|b\\c"
    assert (back["event"], back["line"], back["severity"], back["folder"]) == ("finding", 2, 8, None)


def test_cef_mail_ocr_and_summary(spark):
    mail = spark.createDataFrame(
        [("/m.pst", "w4.pdf", "SSN", "low", 3, "1 2=", "x=y\nz", "Inbox", "Re: a=b", "HR <h*@x.com>", "2026-10-07 09:15", "w4.pdf"),
         ("/n.pst", "n.pst", "SSN", "medium", 1, "3", "c", None, "only subject", None, None, None)], MAIL)
    first, second = events.parse_cef(mail.select(events.to_cef(mail).alias("value"))).orderBy("path").collect()
    assert (first["folder"], first["subject"], first["from"], first["date"], first["attachment"], first["match"], first["context"]) == (
        "Inbox", "Re: a=b", "HR <h*@x.com>", "2026-10-07 09:15", "w4.pdf", "1 2=", "x=y\nz")
    assert (second["folder"], second["subject"], second["attachment"]) == ("", "only subject", "")
    gap = spark.createDataFrame([("/a/scan.pdf",)], "path string").select(events.needs_ocr_cef(F.col("path")).alias("value"))
    assert "|needs-ocr|Document not searched - needs OCR|5|filePath=/a/scan.pdf fname=scan.pdf msg=Scanned" in gap.first()[0]
    assert events.parse_cef(gap).first()["event"] == "needs_ocr"
    coverage = spark.createDataFrame([("a", "scanned"), ("b", "skipped")], "path string, status string")
    summary = rollup.run_summary(mail, coverage, roots=["/data", "/x"], duration="1ms")
    line = summary.select(events.summary_cef(summary).alias("value"))
    assert line.first()[0].endswith(
        "|scan-summary|PII scan completed|3|cn1Label=findings cn1=2 cn2Label=filesScanned cn2=1 cn3Label=filesNeedOcr cn3=0 "
        "msg=roots: /data, /x; duration 1ms; skipped 1; cloud-skipped 0; mail-stores-skipped 0; unreadable-docs 0; unreadable 0")
    parsed = events.parse_cef(line).first()
    assert (parsed["event"], parsed["findings"], parsed["files_scanned"]) == ("scan_summary", 2, 1)


def test_wrapped_json_and_foreign_lines(spark, findings):
    fmt = events.EventFormat(event_key="kind")
    odd = findings.withColumn("context", F.lit("CEF:0|a|b|1|ssn|PII detected: SSN|8|filePath=/x msg=y"))
    written = events.to_events(odd, now(), F.lit("h"), fmt=fmt)
    payload = written.select(events.event_json(written, fmt)).first()[0]
    braced = findings.withColumn("context", F.lit('seen: {"kind":"scan_summary"}'))
    header = "Jul  2 09:00:00 h pii-scan: "
    lines = [
        payload, header + payload, "<133>" + header + payload,
        header + braced.select(events.to_cef(braced)).first()[0],
        header + "CEF:0|other|firewall|2|100|blocked|5|src=10.0.0.1 cn1=7",
        "<134>" + header + '{"kind":"scan_summary","findings":3,"files_errored":2,"roots":["/a"]}',
        header + "started", header + 'took {"kind":"finding"}',
    ]
    table = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    rows = {r["i"]: r for r in events.parse_cef(table, fmt=fmt).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5]
    for i in range(3):
        assert (rows[i]["event"], rows[i]["path"], rows[i]["category_id"], rows[i]["line"]) == ("finding", "/data/hr/pay=roll.csv", "ssn", 2)
        assert rows[i]["context"].startswith("CEF:0|a") and rows[i]["timestamp"] == "2026-07-02T09:00:00Z" and rows[i]["severity"] is None
    assert (rows[3]["event"], rows[3]["severity"], rows[3]["context"]) == ("finding", 8, 'seen: {"kind":"scan_summary"}')
    assert (rows[4]["event"], rows[4]["tool"], rows[4]["category_id"], rows[4]["line"]) == (None, "firewall", None, None)
    assert (rows[5]["event"], rows[5]["findings"], rows[5]["files_errored"], rows[5]["roots"]) == ("scan_summary", 3, 2, ["/a"])


def test_json_lines(spark, findings, tmp_path):
    fmt = events.EventFormat(event_key="kind")
    written = events.to_events(findings, now(), F.lit("h"), fmt=fmt)
    path = str(tmp_path / "log")
    for _ in range(2):
        events.write_events(written, path, fmt)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert len(lines) == 2
    assert list(json.loads(lines[0])) == [
        "tool", "kind", "version", "timestamp", "host", "masked", "category_id", "path", "file_name", "category",
        "confidence", "line", "match", "context"]
    back = read_events(spark, path, fmt).first()
    assert (back["event"], back["timestamp"], back["category_id"]) == ("finding", "2026-07-02T09:00:00Z", "ssn")
    old = spark.createDataFrame([('{"event_type":"finding","path":"p"}',), ('{"kind":"scan_summary"}',), ("junk",)], "value string")
    assert [r["path"] for r in only_findings(from_lines(old, fmt)).collect()] == ["p"]
    wrapped = spark.createDataFrame([("<133>Jul  2 09:00:00 h pii-scan: " + lines[0],)], "value string")
    assert events.parse_wrapped_json(wrapped, fmt=fmt).first()["path"] == "/data/hr/pay=roll.csv"


def test_alerts(spark):
    schema = "id int, event string, confidence string, category_id string, ocr boolean, subject string, attachment string"
    cases = [
        ("finding", "high", "email-address", None, None, None, 100951, 10),
        ("finding", "medium", "phone-number", None, None, None, 100952, 7),
        ("finding", "high", "ssn", None, None, None, 100953, 12),
        ("finding", "medium", "diagnosis-code-hipaa", None, None, None, 100954, 12),
        ("finding", "medium", "scope-indicator-cmmc", None, None, None, 100962, 10),
        ("finding", "high", "bank-routing-number", True, None, None, 100959, 8),
        ("finding", "high", "ssn", True, None, None, 100960, 10),
        ("finding", "medium", "medical-record-number-hipaa", True, None, None, 100961, 10),
        ("finding", "high", "document-marking-cmmc", True, None, None, 100963, 8),
        ("finding", "medium", "phone-number", None, "s", None, 100970, 10),
        ("finding", "high", "ssn", None, "s", None, 100971, 12),
        ("finding", "high", "ssn", None, "s", "a.csv", 100972, 12),
        ("finding", "low", "x", None, None, None, None, None),
        ("needs_ocr", None, None, None, None, None, 100955, 5),
        ("scan_summary", None, None, None, None, None, 100956, 3),
    ]
    table = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], schema)
    got = {r["id"]: (r["rule_id"], r["level"]) for r in alerts.assign_alerts(table).collect()}
    assert got == {i: c[6:] for i, c in enumerate(cases) if c[6]}
    rolled = {(r["level"], r["compliance_group"]): r["alerts"] for r in alerts.alert_rollup(alerts.assign_alerts(table)).collect()}
    assert rolled[(12, alerts.HIPAA)] == 3 and rolled[(5, None)] == 1
    assert alerts.rules_table(spark).count() == 14


def test_csv_report(spark, findings, tmp_path):
    risky = findings.withColumn("match", F.lit("+1 412"))
    assert csv_rows(risky).first()["match"] == "'+1 412"
    write_report_csv(risky, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines()[0] == "path,file_name,category,confidence,line,match,context,folder,subject,date,from,attachment"


def test_history(spark, findings, tmp_path):
    report = {"tool": "t", "version": "1", "generated_at": "2026-07-02T09:00:00Z", "roots": ["/data"], "masked": True,
              "duration": "1s", "stats": {"files_scanned": 6}, "findings": [{"path": "a"}, {"path": "b"}],
              "params": {"min_confidence": "low", "max_size_mb": 50}}
    (tmp_path / "scan-2026-07-02_090000.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "scan-2026-07-03_090000.json").write_text(json.dumps({**report, "generated_at": "2026-07-03T09:00:00Z", "findings": None}))
    (tmp_path / "scan-2026-07-04_090000.json").write_text('{"tool": "t", "gener')
    (tmp_path / "scan-2026-07-05_090000.json").write_text('{"tool": "foreign"}')
    (tmp_path / "scan-notes.json").write_text(json.dumps(report))
    rows = scan_history(read_reports(spark, str(tmp_path))).collect()
    assert [(r["name"], r["findings"], r["files_scanned"]) for r in rows] == [
        ("scan-2026-07-03_090000.json", 0, 6), ("scan-2026-07-02_090000.json", 2, 6)]
    assert rows[1]["params"]["max_size_mb"] == 50


def test_report_and_archive(spark, findings, tmp_path):
    coverage = spark.createDataFrame([("a", "scanned")], "path string, status string")
    summary = rollup.run_summary(findings, coverage, roots=["/data"], duration="1s")
    settings = ScanSettings(max_size_mb=2048, excludes=("*.bak",))
    header = report_header(summary, now(), params=params_column(settings))
    write_report_json(header, findings, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/report")).first()["finding_count"] == 1
    assert spark.read.json(str(tmp_path / "run/findings")).count() == 1
    archive = str(tmp_path / "archive")
    # an interrupted call leaves findings without a header: not part of the archive, and replaced
    findings.union(findings).write.parquet(f"{archive}/findings/run=scan-2026-07-02_090000")
    names = [archive_run(header, findings, archive) for _ in range(2)]  # a retry changes nothing
    later = report_header(summary, F.expr("timestamp '2026-07-03 09:00:00'"), params=params_column(settings))
    names.append(archive_run(later, findings.union(findings), archive))
    assert names == ["scan-2026-07-02_090000"] * 2 + ["scan-2026-07-03_090000"]
    held = spark.read.parquet(f"{archive}/findings").groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in held} == {names[0]: 1, names[2]: 2}
    history = scan_history(read_archive(spark, archive)).collect()
    assert [(r["name"], r["findings"], r["params"]["max_size_mb"]) for r in history] == [(names[2], 1, 2048), (names[0], 1, 2048)]
    lines = {r["label"]: r["value"] for r in describe_params(header.select("params")).collect()}
    assert lines["largest file"] == "2048 MiB" and lines["excluded"] == "*.bak" and lines["categories"] == "-"


def test_manifest():
    text = '{"paths": ["/a"], "excludes": ["x"], "max_size_mb": 10, "workers": 4, "categories": ["ssn"]}'
    for data in (text, text.encode("utf-8-sig"), text.encode("utf-16"), b"\xfe\xff" + text.encode("utf-16-be")):
        assert load_manifest(data)["max_size_mb"] == 10
    for bad in ('{"pathes": []}', '{"ocr": "yes"}', '{"paths": "x"}', '{"max_size_mb": true}', "[]", "{"):
        with pytest.raises(ValueError):
            load_manifest(bad)
    merged = merge_settings(load_manifest(text), excludes=["y"], paths=(), min_confidence="high").checked()
    assert merged.paths == ("/a",) and merged.excludes == ("y", "x") and merged.categories == ("SSN",)
    assert merge_settings(load_manifest(text), paths=["/b"]).paths == ("/b",)
    assert ScanSettings().size_limit_mb() == 50 and ScanSettings(mail=True).size_limit_mb() == 51200
    with pytest.raises(ValueError):
        ScanSettings(min_confidence="sure").checked()
