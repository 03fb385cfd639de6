"""Tables in one row group, and results that must not be computed twice."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from veilscan.functions import patterns as P
from veilscan.functions.storage import spread
from veilscan.operators import rollup
from veilscan.operators.detectors import DEFAULT_DETECTORS, MEDIUM, Detector

SF = "/root/testdata/sf0.001"


def tasks(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_one_row_group_is_scanned_by_many_tasks(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    dealt = spread(read)
    assert tasks(read) == 1
    assert tasks(dealt) >= 2 * spark.sparkContext.defaultParallelism
    assert dealt.count() == dealt.distinct().count() == 4000


@pytest.mark.parametrize("name", ["detect_ssn", "spans_dedupe", "parse_cef", "pii_findings", "explode_messages", "attach_secrets"])
def test_queries_over_customers_use_many_tasks(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tasks(QUERIES[name](spark, SF)) > 1


def test_document_pages_reads_its_findings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(600).select(
        (F.col("id") % 3).cast("string").alias("path"), F.lit("SSN").alias("category"), F.col("id").cast("int").alias("line")
    )
    found = rows.mapInPandas(counted, rows.schema)
    pages = rollup.document_pages(found, size=50).collect()
    assert sum(len(p["findings"]) for p in pages) == 600
    assert seen.value == 600


# matches that begin with each letter of KEYWORD_STARTS, in both cases
_BEGINNINGS = {
    P.KW_SSN: "ssn|social sec|tax id|tin|ſsn",
    P.KW_DOB: "dob|date of birth|birth date|born",
    P.KW_LICENSE: "driver's license|driver lic|dl #|license no",
    P.KW_PASSPORT: "passport|paſsport",
    P.KW_ROUTING: "routing|aba|rtn",
    P.KW_ACCOUNT: "bank account|checking account|savings account|ſavings account|account number|acct no",
    P.KW_PHONE: "phone|tel|mobile|cell|fax|call",
    P.KW_MEDICARE: "medicare|mbi|beneficiary",
    P.KW_MEDICAL_RECORD: "mrn|medical record|patient id",
    P.KW_DIAGNOSIS: "diagnosis|icd-10|icd9|dx",
    P.KW_MARKING: "controlled unclassified|federal contract|cui //|controlled|dissemination|distribution statement|dfars|800-171|"
    "cmmc|noforn|fouo|export-controlled|itar",
    P.KW_EXPORT: "export|munitions|defense article|usml|arms regulations|commerce control|technical data",
    P.KW_NIST: "nist|sp|ſp|rev|revision|assessment|compliance|dfars|cmmc",
    P.KW_CONTRACT: "contract|award|task order|delivery order|solicitation|ſolicitation|procurement|dfars|cage",
}


@pytest.mark.parametrize("keywords", [d.keywords for d in DEFAULT_DETECTORS if d.keywords])
def test_keywords_are_found_wherever_they_begin(spark, keywords):
    detector = Detector("x", "x", keywords=keywords, need_keyword=True, base=MEDIUM)
    # the long s is no word character: its edge is behind the letter before it
    texts = [f"a{w} b" if w[0] == "ſ" else f"a {v} b" for w in _BEGINNINGS[keywords].split("|") for v in (w, w.upper())]
    rows = spark.createDataFrame([(t, t.encode().decode("latin-1")) for t in texts], "text string, view string")
    missed = rows.where(
        ~F.col("view").rlike(detector.keyword_java()) | ~F.col("text").rlike(detector.keyword_java("char", boundaries=False))
    )
    assert [r["text"] for r in missed.collect()] == []
    letters = set(re.findall(r"[a-z0-9]", P.KEYWORD_STARTS[keywords]))
    assert letters >= {w[0] for w in _BEGINNINGS[keywords].split("|") if w[0] != "ſ"}
