import random

import pytest

from tests import slow
from veilscan.functions import patterns as P
from veilscan.operators.detectors import DEFAULT, HIGH, Detector, list_categories, register_detector

SSN, CARD, MARK, SCOPE = P.SSN, P.CREDIT_CARD, P.MARKING, P.SCOPE

ONE_LINERS = {
    "SSN: 219-09-9999": [(SSN, "219-09-9999", 5, 16, "high")],
    "employee ssn 219099999": [(SSN, "219099999", 13, 22, "high")],
    "order id 219099999": [],
    "SSN: 000-12-3456": [],
    "SSN: 123-00-3456": [],
    "taxpayer ITIN 912-83-4567": [("ITIN", "912-83-4567", 14, 25, "high")],
    "card 4111 1111 1111 1112": [],
    "card 9111 1111 1111 1111": [],
    "routing number 021000021": [(P.ROUTING, "021000021", 15, 24, "high")],
    "date of birth: 03/14/1985": [(P.DATE_OF_BIRTH, "03/14/1985", 15, 25, "high")],
    "invoice date 03/14/1985": [],
    "patient mrn 8675309": [(P.MEDICAL_RECORD, "8675309", 12, 19, "medium")],
    "customer email jane@example.com": [(P.EMAIL, "jane@example.com", 15, 31, "medium")],
    "marked CUI per DFARS 252.204-7012": [(MARK, "CUI", 7, 10, "high"), (SCOPE, "252.204-7012", 21, 33, "high")],
    "CUIDADO": [],
    "ITAR: defense articles and technical data": [(SCOPE, "ITAR", 0, 4, "high")],
    "classified EAR99 under the export regulations": [(SCOPE, "EAR99", 11, 16, "high")],
    "NIST SP 800-171 Rev 2 assessment": [(SCOPE, "800-171", 8, 15, "high")],
    "Distribution Statement D applies": [(SCOPE, "Distribution Statement D", 0, 24, "high")],
    "Distribution Statement A": [],
    "this material is export-controlled": [(SCOPE, "export-controlled", 17, 34, "high")],
    "handling of federal contract information (FCI)": [
        (MARK, "federal contract information", 12, 40, "high"), (MARK, "FCI", 42, 45, "high")],
    "Header: FCI\nnext": [(MARK, "FCI", 8, 11, "medium")],
    "card 4111111111111111 123": [(CARD, "4111111111111111", 5, 21, "high")],
    "card: 4111 1111 1111 1111 12/26": [(CARD, "4111 1111 1111 1111", 6, 25, "high")],
    "ref 123 4111 1111 1111 1111": [(CARD, "4111 1111 1111 1111", 8, 27, "high")],
    "amex 3782 822463 10005 1234": [(CARD, "3782 822463 10005", 5, 22, "high")],
    "4111 1111 1111 1111 5555 5555 5555 4444": [
        (CARD, "4111 1111 1111 1111", 0, 19, "high"), (CARD, "5555 5555 5555 4444", 20, 39, "high")],
    "CUI//SP-PRIV": [(MARK, "CUI//SP-PRIV", 0, 12, "high")],
    "Header: CUI\nBody text.": [(MARK, "CUI", 8, 11, "medium")],
    "TLP:AMBER+STRICT": [(MARK, "TLP:AMBER+STRICT", 0, 16, "high")],
    "tlp red": [(MARK, "tlp red", 0, 7, "high")],
    "TLP:CLEAR": [],
    "Contract No. W91QUZ-18-C-0022": [(SCOPE, "W91QUZ-18-C-0022", 13, 29, "medium")],
    "part W91QUZ-18-C-0022 in inventory": [],
    "see 800-171 controls": [(SCOPE, "800-171", 4, 11, "medium")],
}


def test_one_liners(scan):
    got = scan(dict(enumerate(ONE_LINERS)))
    for i, (text, want) in enumerate(ONE_LINERS.items()):
        found = [(r["category"], r["match"], r["start"], r["end"], r["confidence"]) for r in got[str(i)]]
        assert found == want, text


def test_record_with_labels_on_every_line(scan):
    text = (
        "Employee record\n---\nSSN: 219-09-9999\nDOB: 03/14/1985\nCard on file: 4111 1111 1111 1111\n"
        "Email: jane.example@example.com\nPhone: (555) 867-5309\nDriver's License: D12345678\n"
        "Passport: 483959274\nRouting 021000021, account number 000123456789\nMedicare: 1EG4-TE5-MK73\n"
        "MRN 8675309 diagnosis E11.9\n"
    )
    got = [(r["line"], r["category"], r["match"], r["confidence"]) for r in scan({1: text})["1"]]
    assert got == [
        (3, SSN, "219-09-9999", "high"),
        (4, P.DATE_OF_BIRTH, "03/14/1985", "high"),
        (5, CARD, "4111 1111 1111 1111", "high"),
        (6, P.EMAIL, "jane.example@example.com", "medium"),
        (7, P.PHONE, "(555) 867-5309", "high"),
        (8, P.DRIVERS_LICENSE, "D12345678", "medium"),
        (9, P.DRIVERS_LICENSE, "483959274", "medium"),
        (9, P.PASSPORT, "483959274", "medium"),
        (10, P.ROUTING, "021000021", "high"),
        (10, P.ACCOUNT, "000123456789", "medium"),
        (11, P.MEDICARE, "1EG4-TE5-MK73", "high"),
        (12, P.MEDICAL_RECORD, "8675309", "medium"),
        (12, P.DIAGNOSIS, "E11.9", "medium"),
    ]


ALPHABETS = (
    "0123456789 -",
    "0123456789  -\nx.",
    ["219-09-9999", "4111 1111 1111 1111", "378282246310005", "5555", "\n", " ", "é", "日", "x", "1", "ſsn ", "K",
     "123-45-6789", "021000021", "912-83-4567", "a@b.co", ".c", "(555) 867-5309", "-", "…", "\t", "\x0b"],
    ["ssn", "SSN", "tax id", "dob", "born", "routing", "account no", "acct. #", "passport", "mrn", "patient no.",
     "driver's license", "dx", "icd-10", "call", "fax", "medicare", " ", "\n", "\n", ":", "x", "é", "219099999",
     "219 09 9999", "03/14/1985", "Sept. 3rd, 1999", "2020-01-02", "D1234567", "AB-12345", "E11.9", "1EG4-TE5-MK73",
     "12345678", "1EG4TE5MK73", " 5", "_", "filler text that takes some room so windows end in the middle of it "],
    ["CUI", "CUI//SP", "/", "=", "+", "FCI", "TLP", ":", "RED", "amber+strict", "ITAR", "EAR99", "export", "-",
     "controlled", " ", "\n", "800-171", "A", "a", "rev", "sp", "nist", "252.204-7012", "W91QUZ-18-C-0022", "award",
     "distribution statement ", "C", "A", "federal", " contract ", "information", "unclassified", "é", "dfars"],
)


def random_texts(seed: int, count: int, longest: int = 60):
    rng = random.Random(seed)
    for i in range(count):
        alphabet = ALPHABETS[i % len(ALPHABETS)]
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))


def test_equals_slow_statement_of_the_rules(scan):
    texts = dict(enumerate(random_texts(7, 1500)))
    got = scan(texts)
    hits = 0
    for key, text in texts.items():
        want = slow.detect(text.encode())
        have = [
            (r["start"], r["end"], r["category"], r["confidence"], r["line"], r["context"]) for r in got[str(key)]
        ]
        assert sorted(have) == sorted(want), repr(text)
        hits += len(want)
        for r in got[str(key)]:
            assert text.encode()[r["start"]:r["end"]].decode() == r["match"]
    assert hits > 1000


def test_invalid_utf8_keeps_offsets(scan):
    raw = b"caf\xe9 \xff\xfe\xc5 ssn 219-09-9999 \xe9\xe9 j@x.org"
    got = scan({1: raw})["1"]
    assert [(r["start"], r["end"], r["match"]) for r in got] == [
        (s, e, raw[s:e].decode()) for s, e, *_ in slow.detect(raw)
    ]
    assert len(got) == 2


@pytest.mark.parametrize("n", range(55, 70))
def test_context_is_cut_between_characters(scan, n):
    text = "é" * n + " 219-09-9999 " + "日" * n
    context = scan({1: text}, categories=[SSN])["1"][0]["context"]
    assert context == slow.detect(text.encode())[0][5]
    assert "219-09-9999" in context and "�" not in context


def test_one_dense_line(scan):
    """Many hits on one line: the work must not grow with its square."""
    text = "ssn 219-09-9999 " * 5000 + "\n" + "4111 1111 1111 1111 " * 3000
    got = scan({1: text}, categories=[SSN, CARD])["1"]
    assert len(got) == 8000
    assert got[4999]["start"] == 4999 * 16 + 4 and got[4999]["line"] == 1
    assert got[-1]["line"] == 2 and got[-1]["end"] == len(text) - 1


def test_long_runs_do_not_overflow(scan):
    text = "1 " * 60000 + "\n" + "a" * 300000 + "\n" + "7" * 100000 + " x@y.org " + "-" * 50000
    got = scan({1: text})["1"]
    assert [r["match"] for r in got] == ["x@y.org"]


def test_restricting_categories_surfaces_what_dedupe_hid(scan):
    text = "ssn and passport 219099999"
    assert [r["category"] for r in scan({1: text})["1"]] == [SSN]
    assert [r["category"] for r in scan({1: text}, categories=["passport number"])["1"]] == [P.PASSPORT]


def test_pages(scan):
    from pyspark.sql import functions as F

    text = "a\nb 219-09-9991\nc\fpage2 first\n219-09-9992 here\n\f219-09-9993"
    paged = scan({1: text}, ocr=F.lit(True))["1"]
    assert [(r["line"], r["page"]) for r in paged] == [(2, 1), (2, 2), (1, 3)]
    assert all(r["ocr"] for r in paged)
    flat = scan({1: text})["1"]
    assert [(r["line"], r["page"]) for r in flat] == [(2, None), (4, None), (5, None)]


def test_names_are_forgiving():
    assert DEFAULT.normalize(["ssn", "email-address", "SSN", "Medicare ID (HIPAA)"]) == [SSN, P.EMAIL, P.MEDICARE]
    with pytest.raises(ValueError, match="unknown category"):
        DEFAULT.normalize(["ssm"])
    assert len(DEFAULT.categories()) == 15


def test_category_list(spark):
    rows = list_categories(spark).orderBy("position").collect()
    assert [r["category"] for r in rows] == DEFAULT.categories()
    assert rows[4]["category_id"] == "phone-number" and rows[6]["category_id"] == "driver-s-license"


def test_own_detector(scan):
    badge = Detector("Badge", r"\bBDG-\d{4}\b", keywords=r"(?i)\bbadge\b", need_keyword=True, boosted=HIGH,
                     validator=lambda v: v != "BDG-0000")
    registry = register_detector(badge)
    text = "badge BDG-1234 and BDG-0000\n\n\nBDG-9999"
    assert [(r["category"], r["match"], r["confidence"]) for r in scan({1: text}, registry=registry)["1"]] == [
        ("Badge", "BDG-1234", "high")
    ]


def test_filters(scan, spark):
    text = "a@x.com b@sub.x.com c@y.org info@z.net ssn 219-09-9999"
    kept = scan({1: text}, exclude_emails=["*@X.com, @y.org", "info@z.net"])["1"]
    assert [r["match"] for r in kept] == ["b@sub.x.com", "219-09-9999"]
    assert [r["match"] for r in scan({1: text}, min_confidence="high")["1"]] == ["219-09-9999"]


def test_detection_expression_is_evaluated_once(spark):
    """No filter is inferred or pushed that would repeat the scan."""
    from veilscan.operators.scan import scan_table

    docs = spark.range(10).selectExpr("id", "concat('ssn 219-09-', id, '999') as text")
    plan = scan_table(docs, "id", "text").where("category = 'SSN'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert "Exchange" not in plan
    assert plan.count("Filter") <= 1


def test_binding_a_value_copies_nothing(spark):
    """A value and what is made of it are handed on as they are: ``transform``
    would copy an array of findings at each of a scan's levels."""
    from pyspark.sql import functions as F

    from veilscan.functions.arrays import let

    df = spark.range(3).select(let(F.sequence(F.lit(0), "id"), lambda a: F.concat(a, a)).alias("twice"))
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["twice"] for r in df.collect()] == [[0, 0], [0, 1, 0, 1], [0, 1, 2, 0, 1, 2]]


def test_runs_shorter_than_a_card_are_not_walked():
    import re

    from veilscan.operators.scan import _DIGIT_RUN

    text = "412-823-0629 x 12 34 4111 1111 1111 1111 9 x 123456789012 x 4111-1111-1111-11a"
    assert [m.group() for m in re.finditer(_DIGIT_RUN, text)] == ["12 34 4111 1111 1111 1111 9", "4111-1111-1111-11a"]


def test_cards_amid_groups_of_other_digits(scan):
    from pyspark.sql import functions as F

    texts = {
        1: "no 4111 1111 1111 1111 12 34\n\f7 4111-1111-1111-1111",
        2: "12 34 4111 1111 1111 1111 9 1 2",  # the first 19 digits at most hold none
    }
    found = scan(texts, categories=["Credit Card"], paged=F.lit(True))
    assert [(r["match"], r["page"], r["line"], r["start"]) for r in found["1"]] == [
        ("4111 1111 1111 1111", 1, 1, 3), ("4111-1111-1111-1111", 2, 1, 32),
    ]
    assert found["2"] == []
