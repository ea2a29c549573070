"""The Python interface for one document: findings as plain objects."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Row, SparkSession

from assayer.operators.findings import ORDER, attach_positions
from assayer.operators.positions import source_index
from assayer.plans.validate import validate as validate_documents
from assayer.rules.pack import RulePack
from assayer.session import session
from assayer.sinks.reports import report_schema
from assayer.sources.documents import expand, read_documents
from assayer.sources.reports import REPORT_VERSION

REPORT_SCHEMA_VERSION = REPORT_VERSION


class Severity(Enum):
    ERROR = "ERROR"
    WARNING = "WARNING"
    INFO = "INFO"
    UNVERIFIABLE = "UNVERIFIABLE"


@dataclass(frozen=True)
class Rule:
    citation: str
    url: str = ""
    retrieved: str = ""


@dataclass(frozen=True)
class Position:
    file: str
    line: int
    column: int


@dataclass(frozen=True)
class Acknowledgment:
    reason: str
    acknowledged_on: str


@dataclass(frozen=True)
class Suggestion:
    value: str
    difference: str


@dataclass(frozen=True)
class Finding:
    """One finding; ``gates`` tells whether it makes a run fail."""

    code: str
    severity: Severity
    location: str
    prop: str
    value: str
    message: str
    rule: Rule
    suggestions: tuple[Suggestion, ...] = ()
    acknowledged: Acknowledgment | None = None
    position: Position | None = None

    @property
    def gates(self) -> bool:
        return self.severity is Severity.ERROR and self.acknowledged is None


def finding_of(row: Row) -> Finding:
    """A row of the findings relation as an object."""
    made = lambda kind, part: kind(**part.asDict()) if part else None
    return Finding(
        row["code"], Severity(row["severity"]), row["location"], row["prop"], row["value"], row["message"], made(Rule, row["rule"]) or Rule(""),
        tuple(made(Suggestion, s) for s in row["suggestions"] or ()), made(Acknowledgment, row["acknowledged"]), made(Position, row["position"]),
    )


def validate_file(
    path: str, rules: RulePack, resolve: Iterable[str] = (), *, suggest: bool = False, locations: bool = False, spark: SparkSession | None = None
) -> list[Finding]:
    """Findings of one document in report order, with further documents to resolve against."""
    spark = spark or session()
    files = expand([path])
    documents = read_documents(spark, sorted({*files, *expand(resolve)}), pattern="*")
    found = validate_documents(documents, rules, spark.createDataFrame([(f,) for f in files], "doc_id string"), suggest)
    if locations:
        found = attach_positions(found, source_index(documents))
    return [finding_of(r) for r in found.orderBy("doc_id", *ORDER).collect()]


def read_report_schema() -> dict[str, Any]:
    """The published shape of the JSON report."""
    return report_schema()
