"""Reports and the archive of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.scalars import csv_safe, file_name
from veilscan.schema import REPORT

REPORT_NAME = r"^scan-[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{6}\.json$"  # fixed value
CSV_COLUMNS = (
    "path", "file_name", "category", "confidence", "line", "match", "context",
    "folder", "subject", "date", "from", "attachment",
)
_CSV_AS_IS = ("category", "confidence", "line", "date")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Archived reports, one row each.  Other files, unreadable ones and those
    without a creation time are left out."""
    raw = (
        spark.read.schema(REPORT)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "scan-*.json")
        .json(folder)
        .withColumn("name", file_name(F.col("_metadata.file_path")))
    )
    made = F.col("generated_at")
    return raw.where(
        F.col("name").rlike(REPORT_NAME) & made.isNotNull() & ~made.startswith("0001-01-01T00:00:00")
    )


def scan_history(reports: DataFrame) -> DataFrame:
    """One line per archived scan, newest first: of reports read from files or
    of an archive."""
    held = F.size("findings").cast("long") if "findings" in reports.columns else F.col("finding_count")
    return reports.select(
        "name",
        F.to_timestamp("generated_at").alias("generated_at"),
        "version",
        "roots",
        "masked",
        "duration",
        F.coalesce(held, F.lit(0)).alias("findings"),
        F.coalesce(F.col("stats.files_scanned"), F.lit(0)).alias("files_scanned"),
        "params",
    ).orderBy(F.desc("generated_at"))


def csv_rows(findings: DataFrame) -> DataFrame:
    """The report's columns with cells that no spreadsheet runs as a formula."""

    def cell(name: str) -> Column:
        if name not in findings.columns:
            return F.lit("")
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return value if name in _CSV_AS_IS else csv_safe(value)

    return findings.select(*[cell(name).alias(name) for name in CSV_COLUMNS])


def write_report_csv(findings: DataFrame, folder: str) -> None:
    csv_rows(findings).write.option("header", True).option("quote", '"').option("escape", '"').mode(
        "overwrite"
    ).csv(folder)


def report_header(
    summary: DataFrame, generated_at: Column, *, tool: str = "pii-scan", version: str = "1.0", params: Column | None = None
) -> DataFrame:
    """Everything of a report but its findings: one row."""
    stats = [f.name for f in REPORT["stats"].dataType]
    return summary.select(
        F.lit(tool).alias("tool"),
        F.lit(version).alias("version"),
        F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        "roots",
        "masked",
        "duration",
        F.struct(*stats).alias("stats"),
        F.col("findings").alias("finding_count"),
        (params if params is not None else F.lit(None)).alias("params"),
    )


def write_report_json(header: DataFrame, findings: DataFrame, folder: str, *, order: Sequence[str] = ("path", "line", "category")) -> None:
    """``folder/report`` holds the header, ``folder/findings`` the findings in
    report order as JSON lines - written in parallel, whatever their number."""
    header.write.mode("overwrite").json(f"{folder}/report")
    findings.orderBy(*order).write.mode("overwrite").json(f"{folder}/findings")


def published(spark: SparkSession, folder: str) -> bool:
    """Whether a folder that is published as one file of lines is there, whole."""
    try:
        return not spark.read.text(folder).isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def archive_run(header: DataFrame, findings: DataFrame, folder: str) -> str:
    """Add a run to the archive and return its name, which tells the second in
    which it was made: its findings go to ``folder/findings/run=...``, then its
    header (one row, one file) to ``folder/reports/...``, which makes it part of
    the archive.

    A run that is there already is left as it is.  What an interrupted call left
    of it is replaced: findings without a header are not part of the archive.
    """
    spark = header.sparkSession
    made = F.to_timestamp("generated_at")
    name = F.concat(F.lit("scan-"), F.date_format(made, "yyyy-MM-dd_HHmmss"))
    run = header.select(name).head()[0]
    if not published(spark, f"{folder}/reports/{run}"):
        findings.write.mode("overwrite").parquet(f"{folder}/findings/run={run}")
        header.withColumn("name", F.lit(run)).coalesce(1).write.mode("overwrite").json(f"{folder}/reports/{run}")
    return run


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The headers of archived runs, for :func:`scan_history`; findings are
    counted in them and stay where they are."""
    kept = [f for f in REPORT if f.name != "findings"]
    counted = [T.StructField("finding_count", T.LongType()), T.StructField("name", T.StringType())]
    schema = T.StructType([*kept, *counted])
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{folder}/reports")
