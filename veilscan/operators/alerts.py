"""Alert rules over scan events.

A child rule replaces the parent whose conditions it narrows.  Where several
rules remain the higher level wins, then the higher rule number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: int
    level: int
    field: str
    pattern: str
    groups: tuple[str, ...] = ()
    parents: tuple[int, ...] = ()


# --- fixed values: rule numbers, levels, conditions and groups ---------------
GDPR, HIPAA, PCI = "gdpr_II_5.1.f", "hipaa_164.312.b", "pci_dss_3.4"
RULES: tuple[Rule, ...] = (
    Rule(100951, 10, "confidence", "high", (GDPR, HIPAA, PCI)),
    Rule(100952, 7, "confidence", "medium", (GDPR,)),
    Rule(100953, 12, "category_id", "ssn|itin|credit-card", (PCI, GDPR)),
    Rule(100954, 12, "category_id", "medicare-id-hipaa|medical-record-number-hipaa|diagnosis-code-hipaa", (HIPAA,)),
    Rule(100962, 10, "category_id", "document-marking-cmmc|scope-indicator-cmmc", ("cmmc", "nist_800_171")),
    Rule(100959, 8, "ocr", "true", (GDPR, HIPAA, PCI), (100951,)),
    Rule(100960, 10, "ocr", "true", (PCI, GDPR), (100953,)),
    Rule(100961, 10, "ocr", "true", (HIPAA,), (100954,)),
    Rule(100963, 8, "ocr", "true", ("cmmc", "nist_800_171"), (100962,)),
    Rule(100970, 10, "subject", ".+", (PCI, GDPR), (100951, 100952)),
    Rule(100971, 12, "subject", ".+", (PCI, GDPR, HIPAA), (100953, 100954, 100962)),
    Rule(100972, 12, "attachment", ".+", (PCI, GDPR, HIPAA), (100970, 100971)),
    Rule(100955, 5, "event", "^needs"),
    Rule(100956, 3, "event", "^scan"),
)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.rule_id, r.level, list(r.parents), r.field, r.pattern, list(r.groups)) for r in rules]
    return spark.createDataFrame(
        rows, "rule_id int, level int, parents array<int>, field string, pattern string, groups array<string>"
    )


def assign_alerts(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``rule_id, level, groups`` to every event that raises an alert.

    The rules are a handful of constants, so they are compiled into one
    expression: no join, and it works on a stream as it is.
    """
    by_id = {r.rule_id: r for r in rules}

    def own(rule: Rule) -> Column:
        if rule.field not in events.columns:
            return F.lit(False)
        value = F.col(rule.field).cast("string")
        if rule.pattern == ".+":
            hit = F.length(value) > 0
        elif rule.pattern.startswith("^"):
            hit = value.startswith(rule.pattern[1:])
        else:
            hit = value.isin(*rule.pattern.split("|"))
        return F.coalesce(hit, F.lit(False))

    def holds(rule: Rule, parent: int | None = None) -> Column:
        """The rule's conditions, reached through ``parent`` or any parent."""
        condition = own(rule)
        parents = [parent] if parent else rule.parents
        if parents:
            reached = F.lit(False)
            for p in parents:
                reached = reached | holds(by_id[p])
            condition = condition & reached
        return condition

    def effective(rule: Rule) -> Column:
        condition = holds(rule)
        for child in rules:
            if rule.rule_id in child.parents:
                condition = condition & ~own(child)
        return condition

    candidates = F.array(
        *[
            F.when(effective(r), F.struct(F.lit(r.level).alias("level"), F.lit(r.rule_id).alias("rule_id")))
            for r in rules
        ]
    )
    best = F.array_max(F.filter(candidates, lambda c: c.isNotNull()))
    groups = F.create_map(
        *[
            part
            for r in rules
            for part in (F.lit(r.rule_id), F.array(*[F.lit(g) for g in r.groups]).cast("array<string>"))
        ]
    )
    return (
        events.withColumn("_best", best)
        .where(F.col("_best").isNotNull())
        .withColumn("rule_id", F.col("_best.rule_id"))
        .withColumn("level", F.col("_best.level"))
        .withColumn("groups", F.element_at(groups, F.col("rule_id")))
        .drop("_best")
    )


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """Alerts per level and compliance group (null: rules without one)."""
    return (
        alerts.select("level", F.explode_outer("groups").alias("compliance_group"))
        .groupBy("level", "compliance_group")
        .agg(F.count("*").alias("alerts"))
    )
