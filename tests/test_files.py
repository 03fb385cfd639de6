import io
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilscan.operators.rollup import coverage_lists, coverage_stats
from veilscan.plans.file_scan import list_files, scan_files
from veilscan.sources import files
from veilscan.sources.credentials import credential_secrets
from veilscan.functions.storage import ensure_checkpoint_dir
from veilscan.sources.files import classify_file, extract_text, limit_size, list_tree, looks_like_text, utf16_order, with_content
from veilscan.sources.manifest import ScanSettings
from veilscan.sources.office import document_text

SSN = b"Employee SSN: 219-09-9999\n"


def tree(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    return str(root)


def listed(spark, root, **settings):
    found = list_files(spark, ScanSettings(paths=(root,), **settings)).select("path", "excluded").collect()
    return {os.path.relpath(r["path"], root): r["excluded"] for r in found}


def test_excludes(spark, tmp_path):
    root = tree(tmp_path, {n: b"x" for n in ("keep.txt", "a.png", "B.PNG", "sub/C.Png", "Backups/old.txt", "backups2/x.txt")})
    got = listed(spark, root, excludes=("*.PNG", "backups"))
    assert got == {"keep.txt": False, "a.png": True, "B.PNG": True, "sub/C.Png": True}
    assert len(listed(spark, root, excludes=("", " ", "*.bak"))) == 6


def test_folders_are_listed_in_chunks(spark, tmp_path, monkeypatch):
    root = tree(tmp_path, {**{f"big/f{n:04d}.txt": b"x" * n for n in range(250)}, "big/sub/y.txt": b"y"})
    monkeypatch.setattr(files, "LISTED_TOGETHER", 100)
    frames = list(files._opened(files._entries)(iter([pd.DataFrame({"path": [f"{root}/big"]})])))
    assert [len(f) for f in frames] == [100, 100, 51]
    listing = files.list_tree(spark, [root])
    assert listing.count() == 251


def test_files_are_chosen_before_they_are_opened(spark, tmp_path):
    root = tree(tmp_path, {"a.txt": b"12345", "b.txt": b"123456", "c.log": b"1", "sub/d.txt": b"1"})
    found = files.read_files(spark, [root], where="length <= 5 and path like '%.txt'")
    assert {os.path.basename(r["path"]): bytes(r["content"]) for r in found.collect()} == {"a.txt": b"12345", "d.txt": b"1"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("length#")  # the filter lies below the reading
    assert files.read_files(spark, [root], F.col("length") > 5).count() == 1


def test_skipped_directories(spark, tmp_path):
    root = tree(tmp_path, {"AppData/Local/c.txt": b"x", "notes.txt": b"x", ".git/config": b"x", ".cache/y.txt": b"x",
                           ".hidden/z.txt": b"x", ".env": b"x"})
    assert set(listed(spark, root)) == {"notes.txt", ".hidden/z.txt", ".env"}
    everything = {"AppData/Local/c.txt", "notes.txt", ".cache/y.txt", ".hidden/z.txt", ".env"}
    assert set(listed(spark, root, scan_all=True)) == everything
    assert set(listed(spark, os.path.join(root, "AppData"))) == {"Local/c.txt"}
    with pytest.raises(Exception):
        listed(spark, os.path.join(root, "missing"))


def test_scan(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:r><w:t>SSN 219-</w:t></w:r><w:r><w:t>09-9999</w:t></w:r></w:p></w:d>')
        z.writestr("word/footer1.xml", '<w:d xmlns:w="w"><w:p><w:t>foot j@x.org</w:t></w:p></w:d>')
    root = tree(tmp_path, {
        "plain.txt": SSN,
        "utf16.txt": "﻿header\nEmployee SSN: 219-09-9999".encode("utf-16-le"),
        "noext": SSN,
        "blob": b"\x7fELF\x00\x01\x02" + SSN,
        "old-payroll.XLS": SSN, "letter.doc": SSN, "photo.gif": SSN, "scan.pdf": b"%PDF", "ocr.pdf": b"%PDF",
        "report.docx": docx.getvalue(), "broken.docx": b"not a zip", "archive.pst": b"x",
        "big.txt": SSN * 50000,
        "creds.csv": b'url,username,password\na.com,u1@x.com,"p,w1234"\nb.com,u2@x.com,ab\n',
    })
    given = spark.createDataFrame([(os.path.join(root, "ocr.pdf"), "one\nssn 219-09-9998\ftwo\nssn 219-09-9997", True)],
                                  "path string, text string, ocr boolean")
    run = scan_files(spark, ScanSettings(paths=(root,), max_size_mb=1), ocr_text=given)
    status = {os.path.basename(r["path"]): r["status"] for r in run.coverage.collect()}
    assert status == {
        "plain.txt": "scanned", "utf16.txt": "scanned", "noext": "scanned", "blob": "skipped",
        "old-payroll.XLS": "unreadable_doc", "letter.doc": "unreadable_doc", "photo.gif": "skipped",
        "scan.pdf": "needs_ocr", "ocr.pdf": "scanned", "report.docx": "scanned", "broken.docx": "error",
        "archive.pst": "mail_store", "big.txt": "oversize", "creds.csv": "scanned",
    }
    found = {(r["file_name"], r["line"], r["page"], r["match"]) for r in run.findings.collect()}
    assert found == {
        ("plain.txt", 1, None, "219-09-9999"), ("utf16.txt", 2, None, "219-09-9999"), ("noext", 1, None, "219-09-9999"),
        ("report.docx", 1, None, "219-09-9999"), ("report.docx", 3, None, "j@x.org"),
        ("ocr.pdf", 2, 1, "219-09-9998"), ("ocr.pdf", 2, 2, "219-09-9997"),
        ("creds.csv", 2, None, "u1@x.com"), ("creds.csv", 3, None, "u2@x.com"),
    }
    contexts = {r["context"] for r in run.masked().where(F.col("file_name") == "creds.csv").collect()}
    assert contexts == {'a.com,u*@x.com,"********"', "b.com,u*@x.com,ab"}
    stats = coverage_stats(run.coverage).first().asDict()
    assert stats["files_scanned"] == 6 and stats["files_ocr"] == 1 and stats["files_errored"] == 1
    gaps = {(r["gap"], os.path.basename(r["entry"].split(":")[0])) for r in coverage_lists(run.coverage).collect()}
    assert gaps == {("needs_ocr", "scan.pdf"), ("unreadable_doc", "old-payroll.XLS"), ("unreadable_doc", "letter.doc"),
                    ("mail_store", "archive.pst"), ("oversize", "big.txt"), ("error", "broken.docx")}


def test_size_filter_reaches_the_source(spark, tmp_path):
    root = tree(tmp_path, {"a.txt": b"x", "b.txt": b"y" * 3_000_000})
    files = limit_size(spark.read.format("binaryFile").load(root), 1)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan
    assert files.count() == 1


def test_every_entry_is_accounted_for(spark, tmp_path):
    outside = tree(tmp_path / "outside", {"o.txt": SSN})
    names = [".env", "a/.b/c.txt", "a/b/c/d/.env", "a/b/c/d/.hid/e/f/.g/x.txt", "_x/y.txt", "plain.txt", "closed.txt"]
    root = tree(tmp_path / "root", {n: SSN for n in names})
    os.symlink(f"{outside}/o.txt", f"{root}/link.txt")
    os.symlink(outside, f"{root}/linked")
    os.symlink(root, f"{root}/a/loop")
    files = list_tree(spark, [root])
    assert {os.path.relpath(r["path"], root) for r in files.collect()} == set(names)
    assert {r["path"] for r in list_tree(spark, [f"{root}/link.txt"]).collect()} == {f"{root}/link.txt"}
    os.remove(f"{root}/closed.txt")  # vanished after it was listed
    read = {os.path.relpath(r["path"], root): r for r in with_content(files).collect()}
    assert read["closed.txt"]["error"] and read["closed.txt"]["content"] is None
    assert all(bytes(read[n]["content"]) == SSN for n in names if n != "closed.txt")
    run = scan_files(spark, ScanSettings(paths=(root,)))
    assert {r["status"] for r in run.coverage.collect()} == {"scanned"} and run.coverage.count() == 6
    assert run.findings.count() == 6


def test_supplied_text_and_settings(spark):
    rows = [(n, 1, b"x", k, False, False) for n, k in (("a.pdf", "pdf"), ("b.pdf", "pdf"), ("c.png", "image"), ("d.png", "image"), ("e.txt", "text"))]
    files = spark.createDataFrame(rows, "path string, length long, content binary, kind string, excluded boolean, oversize boolean")
    given = spark.createDataFrame([("a.pdf", " ", False), ("b.pdf", "w " * 30, False), ("c.png", "x", True), ("e.txt", "other", False)],
                                  "path string, text string, ocr boolean")
    got = {r["path"]: (r["status"], bytes(r["text"] or b"")[:2]) for r in extract_text(files, ocr_text=given, ocr=True).collect()}
    assert got == {"a.pdf": ("needs_ocr", b" "), "b.pdf": ("scanned", b"w "), "c.png": ("scanned", b"x"), "d.png": ("needs_ocr", b""), "e.txt": ("scanned", b"x")}
    for settings in (ScanSettings(mail=True), ScanSettings(include_cloud=True)):
        with pytest.raises(ValueError):
            scan_files(spark, settings)


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_kinds_and_sniffing(spark):
    names = {"a.DOCX": "docx", "b.xlsm": "xlsx", "c.pptx": "pptx", "d.pdf": "pdf", "e.TIF": "image", "f.one": "unreadable_doc",
             "g.so": "binary", "h.env": "text", "i": "sniff", "j.py": "sniff", "k.ost": "mail_store", "l.olk14MsgSource": "mail_store"}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", classify_file(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == names
    cases = [(b"", None, True), (b"abc\n", None, True), (b"a\0b", None, False), (b"\x01" * 5 + b"x" * 95, None, False),
             (b"\x01" * 4 + b"x" * 96, None, True), (b"\xff\xfea\0", "LE", False), (b"\xfe\xff\0a", "BE", False),
             ("plain text".encode("utf-16-le"), "LE", False), ("plain text".encode("utf-16-be") + b"x", "BE", False)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _, _) in enumerate(cases)], "i int, b binary")
    got = rows.select("i", utf16_order(F.col("b")).alias("o"), looks_like_text(F.decode("b", "ISO-8859-1")).alias("t"))
    assert [(r["o"], r["t"]) for r in got.orderBy("i").collect()] == [(o, t) for _, o, t in cases]


def test_extraction_helpers():
    assert document_text("utf16LE", "ab".encode("utf-16-le") + b"c") == "ab�"
    assert document_text("utf16LE", b"\xff\xfea\x00\x00\xd8") == "a�"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>first</t></si><si><t>second</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml",
                   '<s><row><c t="s"><v>0</v></c><c><v>42</v></c><c t="inlineStr"><is><t>x</t></is></c></row></s>')
    assert document_text("xlsx", book.getvalue()) == "first\nsecond\n42 x \n"


def test_credential_secrets(spark):
    texts = {
        "a.csv": 'url,username,password\na.com,u1,"p,w1234"\nb.com,u2,ab\n"x\ny",u3,longer\n',
        "b.csv": "a,b\n1,secret password\n",
        "c.CSV": '\r\nnote,My_Password ,totp\r\n"two\nlines",hunter2x,otp12345\r\n"q""x" y",v"alue1,t\nlast,endvalue',
        "d.txt": "password\nhunter2x",
        "e.csv": None,
        "f.csv": "",
        "g.csv": ',password\n,value9\n,"open,vvvv\n' + '""' * 20_000,
    }
    table = spark.createDataFrame(list(texts.items()), "path string, text string")
    found = credential_secrets(table)
    assert "Python" not in found._jdf.queryExecution().toString() and "MapIn" not in found._jdf.queryExecution().toString()
    got = sorted((r["path"], r["line"], r["value"][:12]) for r in found.collect())
    assert got == [
        ("a.csv", 2, "p,w1234"), ("a.csv", 4, "longer"), ("a.csv", 5, "longer"),
        ("c.CSV", 3, "hunter2x"), ("c.CSV", 3, "otp12345"), ("c.CSV", 4, "hunter2x"), ("c.CSV", 4, "otp12345"),
        ("c.CSV", 5, 'v"alue1'), ("c.CSV", 6, "endvalue"),
        ("g.csv", 2, "value9"), ("g.csv", 3, 'open,vvvv\n""'),
    ]
