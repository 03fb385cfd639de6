import random

import pytest
from pyspark.sql import functions as F

from tests import slow
from veilscan.functions import scalars as S
from veilscan.functions.sql import register_functions, register_scan_functions, register_scan_view
from veilscan.operators import masking
from veilscan.operators.detectors import Detector, register_detector
from veilscan.operators.masking import mask_array, mask_findings
from veilscan.operators.scan import scan_table

FINDING = "path string, category string, match string, context string, subject string, `from` string, redact array<string>"


def one(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_mask(spark):
    got = one(spark, S.mask, "412-823-0629", "j.smith@comcast.net", "@x.y", "é1234567", "1EG4-TE5-MK73", "abc", "a@b")
    assert got == ["***-***-0629", "j******@comcast.net", "@x.y", "é***4567", "****-***-MK73", "abc", "a@b"]


def test_mask_from(spark):
    got = one(spark, S.mask_from, "Jane Doe <jane.doe@example.com>", "Payroll Team", "a.b@c.org", "x <", "<>")
    assert got == ["Jane Doe <j*******@example.com>", "Payroll Team", "a**@c.org", "x <", "<>"]


def test_csv_safe(spark):
    got = one(spark, S.csv_safe, "+1 412-823-0629", '=HYPERLINK("x")', "-1", "@a", "\tx", "\rx", "plain", "")
    assert got == ["'+1 412-823-0629", "'=HYPERLINK(\"x\")", "'-1", "'@a", "'\tx", "'\rx", "plain", ""]


def test_text_scalars(spark):
    assert one(spark, S.one_line, " a\n b\t c \x0b d ") == ["a b c d"]
    assert one(spark, S.category_slug, "Driver's License", "Medicare ID (HIPAA)", "--x--") == [
        "driver-s-license", "medicare-id-hipaa", "x"]
    assert one(spark, S.cef_escape_ext, "a=b\\c\nd\re") == ["a\\=b\\\\c\\nd\\re"]
    assert one(spark, lambda v: S.cef_unescape(S.cef_escape_ext(v)), "a=b\\n\\c\nd") == ["a=b\\n\\c\nd"]
    assert one(spark, S.file_name, "/a/b.txt", "b", "/a/b/") == ["b.txt", "b", "b"]
    assert one(spark, S.lacks_text_layer, " a b c ", "x" * 20, "x " * 19) == [True, False, True]
    assert one(spark, lambda v: S.rough_age(v.cast("long")), "3599", "3600", "172799", "172800") == [
        "59 min", "1 h", "47 h", "2 days"]


def masked(spark, rows):
    found = spark.createDataFrame([(*r, None, None, None)[:7] if len(r) < 7 else r for r in rows], FINDING)
    found = found.withColumns({"line": F.lit(1), "start": F.monotonically_increasing_id()})
    return mask_findings(found).orderBy("path", "start").collect()


def test_siblings_hide_each_other(spark):
    line = "PHONE 412-823-0629  FAX 412-823-8314"
    rows = masked(spark, [("a", "Phone Number", "412-823-0629", line), ("a", "Phone Number", "412-823-8314", line),
                          ("b", "SSN", "219-09-9999", "219-09-9999 412-823-0629")])
    assert [r["context"] for r in rows] == ["PHONE ***-***-0629  FAX ***-***-8314"] * 2 + ["***-**-9999 412-823-0629"]
    assert [r["match"] for r in rows] == ["***-***-0629", "***-***-8314", "***-**-9999"]


def test_secrets_markings_and_mail_fields(spark):
    rows = masked(spark, [
        ("a", "Email Address", "j@x.org", "site,j@x.org,Jmmyann822", "pw Jmmyann822", "J <j@x.org>", ["Jmmyann822"]),
        ("a", "Document Marking (CMMC)", "CUI//SP-PRIV", "CUI//SP-PRIV — j@x.org Jmmyann822 j@x.org", None, None, None),
        ("a", "SSN", "823-0629", "823-0629 in 412-823-0629", None, None, None),
        ("a", "Phone Number", "412-823-0629", "412-823-0629", None, None, None),
    ])
    assert rows[0]["context"] == "site,j@x.org,********" and rows[0]["subject"] == "pw ********"
    assert rows[0]["from"] == "J <j@x.org>"
    assert rows[1]["match"] == "CUI//SP-PRIV" and rows[1]["context"] == "CUI//SP-PRIV — j@x.org ******** j@x.org"
    assert rows[2]["context"] == "***-0629 in ***-***-0629"
    assert "redact" not in rows[0].asDict()


def test_in_row_and_relational_masking_agree(spark):
    from tests.test_detect import random_texts

    texts = [(str(i), t) for i, t in enumerate(random_texts(3, 300))]
    docs = spark.createDataFrame(texts, "id string, text string")
    plain = scan_table(docs, "id", "text")
    inside = scan_table(docs, "id", "text", transform_findings=mask_array)
    columns = ["doc_id", "start", "end", "category", "match", "context"]
    a = sorted(map(tuple, mask_findings(plain).select(*columns).collect()))
    b = sorted(map(tuple, inside.select(*columns).collect()))
    assert a == b and len(a) > 200


def some_findings():
    pick = random.Random(11)
    rows = []
    for n in range(900):
        path = None if n % 19 == 0 else "hot.mbox" if n % 3 == 0 else f"d{pick.randrange(60)}"
        phone = [f"412-823-{pick.randrange(100, 140):04}" for _ in range(3)]
        category, match = pick.choice([("Phone Number", phone[0]), ("Email Address", f"j{pick.randrange(40)}@x.org"), ("Document Marking (CMMC)", "CUI")])
        redact = [f"pw{pick.randrange(30)}"] if n % 7 == 0 else [] if n % 5 == 0 else None
        context = f"{match} {phone[1]} — j{pick.randrange(40)}@x.org pw{pick.randrange(30)} {phone[2][4:]}"
        rows.append((path, category, match, context, pick.choice([None, "", f"re {phone[1]}"]), "J <j@x.org>", redact, n % 5, n))
    return rows


@pytest.mark.parametrize("small", [0, 20, 256])
def test_a_documents_size_changes_nothing(spark, monkeypatch, small):
    monkeypatch.setattr(masking, "SMALL", small)
    rows = some_findings()
    found = spark.createDataFrame(rows, FINDING + ", line int, start int").repartition(5)
    got = {r["start"]: (r["match"], r["context"], r["subject"]) for r in mask_findings(found).collect()}

    def hide(value):
        return value[0] + "*" * (value.index("@") - 1) + value[value.index("@"):] if "@" in value else "***-***-" + value[-4:]

    documents = {}
    for path, category, match, _, _, _, redact, line, start in rows:
        values = documents.setdefault(path, {})
        for value, kind in [*((v, 0) for v in redact or ()), *([(match, 1)] if category != "Document Marking (CMMC)" else [])]:
            values[value] = min(values.get(value, (kind, line, start)), (kind, line, start))
    assert len(got) == len(rows)
    for path, category, match, context, subject, _, _, _, start in rows:
        for value, (kind, *_) in sorted(documents[path].items(), key=lambda e: (-len(e[0]), e[1])):
            masked = hide(value) if kind else "********"
            context, subject = context.replace(value, masked), subject and subject.replace(value, masked)
        assert got[start] == (match if category == "Document Marking (CMMC)" else hide(match), context, subject)


def test_no_row_for_each_place_of_an_ordinary_document(spark):
    found = spark.createDataFrame(some_findings(), FINDING + ", line int, start int").where("path like 'd%'")
    plan = mask_findings(found)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_sql_functions(spark):
    assert set(register_functions(spark)) == {"pii_mask", "pii_category_slug", "pii_csv_safe", "pii_luhn", "pii_aba"}
    row = spark.sql(
        "SELECT pii_mask('412-823-0629') a, pii_mask('j.smith@comcast.net') b, pii_category_slug('Bank Account Number') c,"
        " pii_luhn('4111111111111111') d, pii_aba('021000021') e, pii_aba('021000022') f, pii_csv_safe('=x') g"
    ).first()
    assert tuple(row) == ("***-***-0629", "j******@comcast.net", "bank-account-number", True, True, False, "'=x")
    spark.createDataFrame([(1, "ssn 219-09-9999")], "id int, note string").createOrReplaceTempView("notes")
    view = register_scan_view(spark, "note_findings", "notes", "id", "note")
    assert spark.sql(f"SELECT category, line FROM {view}").first()[:] == ("SSN", 1)


def test_sql_table_function(spark):
    from tests.test_detect import random_texts

    own = register_detector(Detector("Quote's \\\\ code", r"\b[0-9]'\([0-9]\\\b"))
    assert register_scan_functions(spark, registry=own, exclude_emails=["x.org"], prefix="own") == ["own_findings", "own_scan"]
    register_scan_functions(spark, min_confidence="high", categories=["ssn"])
    register_scan_functions(spark, min_confidence="high", categories=["ssn"])  # again
    texts = [*random_texts(5, 200), None, "", "7'(7\\a and j@x.org, j@y.org", "ssn 219-09-9999; 'and(x' -> 411 111\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    columns = ["id", "category", "confidence", "line", "page", "match", "context", "start", "end"]

    def wanted(**options):
        rows = scan_table(docs, "id", "text", **options).withColumn("id", F.col("doc_id").cast("int"))
        return sorted(map(tuple, rows.select(columns).collect()), key=repr)

    queries = {
        "SELECT d.id, f.* FROM {docs} d, LATERAL own_scan(d.text) f": {"registry": own, "exclude_emails": ["x.org"]},
        "SELECT id, inline(f) FROM (SELECT id, own_findings(text) f FROM {docs})": {"registry": own, "exclude_emails": ["x.org"]},
        "SELECT d.id, f.* FROM {docs} d, LATERAL pii_scan(d.text) f": {"min_confidence": "high", "categories": ["SSN"]},
    }
    for query, options in queries.items():
        found = spark.sql(query, docs=docs)
        assert found.columns == columns
        assert sorted(map(tuple, found.collect()), key=repr) == wanted(**options)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Join", "Exchange"))
    outer = "SELECT id, match FROM (SELECT id, inline_outer(f) FROM (SELECT id, pii_findings(text) f FROM {docs} WHERE id >= 200))"
    left = spark.sql(outer, docs=docs)
    assert sorted(map(tuple, left.collect()), key=repr) == [(200, None), (201, None), (202, None), (203, "219-09-9999")]
    assert [r["category"] for r in spark.sql("SELECT category FROM own_scan('8\\'(8\\\\b')").collect()] == ["Quote's \\\\ code"]


@pytest.mark.parametrize("digits", ["4111111111111111", "2221000000000009", "6011000000000004", "30569309025904",
                                    "3530111333300000", "1111111111111", "9111111111111111", "2220999999999999"])
def test_cards(spark, digits):
    from veilscan.functions.validators import valid_card

    assert one(spark, valid_card, digits) == [slow.card(digits)]
