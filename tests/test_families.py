"""What is found once for several detectors, and computed once for a text."""

import pytest
from pyspark.sql import functions as F

from veilscan.functions import patterns as P
from veilscan.functions.arrays import running_states
from veilscan.operators.detectors import DEFAULT_DETECTORS, FAMILIES, Registry
from veilscan.operators.scan import detect, scan_table

NUMBERS = (P.SSN, P.ITIN, P.PASSPORT, P.ROUTING, P.ACCOUNT, P.MEDICAL_RECORD)
TEXTS = {
    "a": "ssn 123-45-6789, 923-71-6789 tin\nrouting 011000015 account no. 12345678901234567 mrn 12345",
    "b": "passport A12345678 x123456789 AB12345678 12345678_ 123456789012345678 acct # 123456",
    "c": "ssn 123-45-6789-71-4321 923-71-6789-11-2222 soc. sec 123456789",
    "d": "paſſport é 123456789 é\npaſſport 日12345678日 MÅ¿N 12345 rtn 122000661",
    "e": "passport\n\n123456789\nmrn 1234567890 patient no 12345 checking account 00123456",
    "f": "born 1/2/1990 dob\n" * 3 + "ssn 111223333 " * 150 + "mrn 55555",
}
BYTES = [
    b"mrn \xff12345\xe2\x84 tin\xf0 123456789 \xc5\xbfsn 123 45 6789",
    b"\xe0\xc5\xbfsn 123456789 \xff\xffpassport\xff 12345678 routing\xc3 011000015",
]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_a_family_finds_what_its_detectors_find_alone(spark, kind):
    rows = list(TEXTS.items()) if kind == "string" else [(str(i), t) for i, t in enumerate(BYTES)]
    docs = spark.createDataFrame(rows, f"id string, text {kind}").coalesce(1).cache()
    columns = ("doc_id", "category", "confidence", "line", "match", "start", "end", "context")
    members = [d for d in DEFAULT_DETECTORS if d.family]
    assert {d.family for d in members} == set(FAMILIES)

    def found(*detectors):
        return {tuple(r) for r in scan_table(docs, "id", "text", registry=Registry(detectors)).select(*columns).collect()}

    ranked = {"low": 0, "medium": 1, "high": 2}
    alone = set().union(*[found(d) for d in members])
    # the most confident of one span are kept
    best = {}
    for r in alone:
        span = (r[0], r[5], r[6])
        best[span] = max(best.get(span, 0), ranked[r[2]])
    want = {r for r in alone if ranked[r[2]] == best[r[0], r[5], r[6]]}
    assert want and found(*members) == want


def test_numbers_are_searched_once(spark):
    members = [d for d in DEFAULT_DETECTORS if getattr(d, "family", True) and d.category in NUMBERS]
    assert len(members) >= 7
    assert str(detect(F.col("text"), Registry(members[:1]))).count("\u0100$0\u0100") == 1
    searches = str(detect(F.col("text"), Registry(members))).count("\u0100$0\u0100")
    assert searches == 2  # was one for each detector


def test_states_are_computed_once(spark):
    states = running_states(F.col("n"), F.lit(0), lambda at, n: at + n)
    assert str(states).count("array_append(") == 3  # one for short arrays, two for chunks
    for size in (0, 1, 127, 128, 129, 256, 300):
        row = spark.range(1).select(states_of(size).alias("s")).first()
        assert row["s"] == [k * (k + 1) // 2 for k in range(1, size + 1)]


def states_of(size):
    items = F.slice(F.sequence(F.lit(1), F.lit(400)), F.lit(1), F.lit(size))
    return running_states(items, F.lit(0), lambda at, n: at + n)
