"""Documents with their findings inside, page by page."""

import random
from collections import Counter

from veilscan.operators.rollup import document_groups, document_pages, document_totals

FINDING = "path string, host string, category string, line int, start int, match string, context string, ocr boolean"


def plain_pages(rows, size, key=lambda r: r[:1]):
    documents = {}
    for row in rows:
        documents.setdefault(key(row), []).append(row)
    out = {}
    for name, found in documents.items():
        # line, category, start, match, then the other columns by name, nulls first
        found.sort(key=lambda r: tuple((x is not None, x) for x in (r[3], r[2], r[4], r[5], r[6], r[1], r[7])))
        counts = Counter(r[2] for r in found)
        totals = [tuple(x) for x in sorted(counts.items(), key=lambda c: (-c[1], c[0]))]
        for at in range(0, len(found), size):
            out[(*name, at // size + 1)] = len(found), totals, found[at : at + size]
    return out


def some_findings():
    pick = random.Random(6)
    rows = []
    for n in range(3000):
        path = "mail/hot.mbox" if n % 3 == 0 else f"d/{pick.randrange(200)}.txt"
        rows.append((path, pick.choice(["h1", "h2", None]), pick.choice(["SSN", "Phone Number", "Email Address"]), pick.randrange(40),
                     pick.randrange(90), f"m{pick.randrange(30)}", pick.choice(["", "c", None]), pick.choice([True, None])))
    rows += [("twice", "h", "SSN", 1, 1, "same", "row", None)] * 7 + [(None, "h", "SSN", 1, 1, "x", "no path", None)] * 3
    return rows


def test_document_pages(spark):
    rows = some_findings()
    table = spark.createDataFrame(rows, FINDING).repartition(6)
    for size in (1, 7, 1000):
        wanted = plain_pages(rows, size)
        pages = document_pages(table, size=size)
        found = pages.collect()
        assert pages.columns == ["path", "page", "total", "categories", "findings"]
        assert len(found) == len(wanted)
        for r in found:
            total, categories, held = wanted[r["path"], r["page"]]
            assert r["total"] == total and [tuple(c) for c in r["categories"]] == categories
            assert [(f["line"], f["category"], f["start"], f["match"], f["context"], f["host"], f["ocr"]) for f in r["findings"]] == [
                (f[3], f[2], f[4], f[5], f[6], f[1], f[7]) for f in held]


def test_document_pages_by_machine(spark):
    rows = some_findings()
    pages = document_pages(spark.createDataFrame(rows, FINDING), key=("host", "path"), size=50).collect()
    wanted = plain_pages(rows, 50, lambda r: (r[1], r[0]))
    assert {(r["host"], r["path"], r["page"]): len(r["findings"]) for r in pages} == {k: len(v[2]) for k, v in wanted.items()}


def test_a_callers_cache_stays(spark):
    from veilscan.functions.storage import materialize

    own = spark.range(10).cache()
    assert materialize(own).count() == 10 and own.storageLevel.useMemory
    own.unpersist()
    other = spark.range(5).selectExpr("id + 1 as x")
    assert sorted(r["x"] for r in materialize(other).collect()) == [1, 2, 3, 4, 5] and not other.storageLevel.useDisk


def test_pages_of_nothing(spark):
    assert document_pages(spark.createDataFrame([], FINDING)).collect() == []


def test_document_groups_hold_their_findings(spark):
    rows = some_findings()
    table = spark.createDataFrame(rows, FINDING).repartition(6)
    wanted = plain_pages(rows, len(rows))
    groups = document_groups(table)
    found = groups.collect()
    assert groups.columns == ["path", "total", "categories", "findings"]
    assert {(r["path"], 1) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        total, categories, held = wanted[r["path"], 1]
        assert r["total"] == total and [tuple(c) for c in r["categories"]] == categories
        assert list(r["findings"][0].asDict()) == ["host", "category", "line", "start", "match", "context", "ocr"]
        assert [(f["line"], f["category"], f["start"], f["match"], f["context"], f["host"], f["ocr"]) for f in r["findings"]] == [
            (f[3], f[2], f[4], f[5], f[6], f[1], f[7]) for f in held]
    totals = {r["path"]: (r["findings"], r["categories"]) for r in document_totals(table).collect()}
    assert totals == {r["path"]: (r["total"], r["categories"]) for r in found}
    machines = {(r["host"], r["path"]): r["total"] for r in document_groups(table, ("host", "path")).collect()}
    assert machines == dict(Counter((r[1], r[0]) for r in rows))
