"""The findings relation and its algebra: one row a finding, totally ordered, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Severities in the order they are counted and printed.
SEVERITIES = ("ERROR", "WARNING", "INFO", "UNVERIFIABLE")
RANK = {"ERROR": 3, "WARNING": 2, "INFO": 1, "UNVERIFIABLE": 0}
FINDING = (
    "doc_id string, code string, severity string, location string, prop string, value string, message string, "
    "rule struct<citation:string,url:string,retrieved:string>, suggestions array<struct<value:string,difference:string>>, "
    "acknowledged struct<reason:string,acknowledged_on:string>, position struct<file:string,line:int,column:int>"
)
COLUMNS = ("doc_id", "code", "severity", "location", "prop", "value", "message", "rule", "suggestions", "acknowledged", "position")
ORDER = ("location", "prop", "code", "value", "severity", "message")

#: Codes by fix tier, first to fix first.
TIERS = (
    ("Supply what the document imports", ("IMPORT_NOT_SUPPLIED", "IMPORT_AMBIGUOUS")),
    ("Shape the validator could not read", ("SUBTREE_NOT_READ", "NO_SCHEMA_ALTERNATIVE", "TYPE_MISMATCH")),
    ("Required structure", ("REQUIRED_PROPERTY_MISSING", "PROPERTY_UNDECLARED", "ARRAY_TOO_SHORT")),
    ("Values against their datatypes", ("DATATYPE_MISMATCH", "DATATYPE_BELOW_MINIMUM")),
    ("Identifiers", ("UUID_NOT_UNIQUE", "CONSTRAINT_NOT_UNIQUE", "CONSTRAINT_CARDINALITY")),
    ("Values against published constraints", ("CONSTRAINT_VALUE_MISMATCH",)),
    ("References that resolve to nothing", ("REFERENCE_UNRESOLVED",)),
    ("Declared version", ("OSCAL_VERSION_DIFFERS", "VERSION_SKEW_SUSPECTED")),
    ("Not settled: UNVERIFIABLE", ("REFERENCE_UNVERIFIABLE", "CONSTRAINT_NOT_EVALUATED", "PATTERN_NOT_CHECKED")),
    ("For the record", ("IMPORT_RESOLVED",)),
    ("Housekeeping: the baseline itself", ("BASELINE_STALE",)),
)
OTHER = "Other"


def as_findings(rows: DataFrame) -> DataFrame:
    """Rows completed to the findings schema; columns that are not there are null."""
    kinds = dict(zip(COLUMNS, _kinds(), strict=True))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def _kinds() -> list[str]:
    found, depth, start = [], 0, 0
    for k, c in enumerate(FINDING + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            found.append(FINDING[start:k].strip().split(" ", 1)[1])
            start = k + 1
    return found


def rule(citation: Column | str, url: str = "", retrieved: str = "") -> Column:
    """The rule struct of a finding."""
    said = F.lit(citation) if isinstance(citation, str) else citation
    return F.struct(said.alias("citation"), F.lit(url).alias("url"), F.lit(retrieved).alias("retrieved"))


def cited(rows: DataFrame, citations: dict[str, dict[str, str]]) -> DataFrame:
    """The findings with the rules that ``citations`` gives their codes: citation, url, retrieved; other codes keep theirs.

    {code}, {property}, {value} and {location} in a citation are filled from the finding.
    """
    if not citations:
        return rows
    said = F.lit(None).cast("struct<citation:string,url:string,retrieved:string>")
    for code, held in citations.items():
        citation = F.lit(held.get("citation", ""))
        for name, column in (("code", "code"), ("property", "prop"), ("value", "value"), ("location", "location")):
            if f"{{{name}}}" in held.get("citation", ""):
                citation = F.replace(citation, F.lit(f"{{{name}}}"), F.coalesce(column, F.lit("")))
        said = F.when(F.col("code") == code, rule(citation, held.get("url", ""), held.get("retrieved", ""))).otherwise(said)
    return rows.withColumn("rule", F.coalesce(said, "rule"))


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings of several checks with the rank of their check."""
    ranked = [as_findings(p).withColumn("check", F.lit(k)) for k, p in enumerate(parts)]
    whole = ranked[0]
    for part in ranked[1:]:
        whole = whole.unionByName(part)
    return whole


def finalize(rows: DataFrame) -> DataFrame:
    """Distinct findings in their total order within each document."""
    return as_findings(rows).distinct().orderBy("doc_id", *ORDER)


def reference_key(rows: DataFrame) -> DataFrame:
    """The findings with ``at`` and ``of``: which reference a report is about, in one spelling."""
    by_property = (F.col("prop") == "href") & F.col("location").endswith("/href")
    at = F.when(by_property, F.expr("substr(location, 1, length(location) - 5)")).otherwise(F.col("location"))
    return rows.withColumns({"at": at, "of": F.regexp_replace("value", "^#", "")})


def merge_references(rows: DataFrame, precedence: str = "check") -> DataFrame:
    """One report for each reference: an unsettled one if there is any, else by the rank of its check, else the first in order."""
    is_reference = F.col("code").startswith("REFERENCE_")
    keyed = reference_key(rows.where(is_reference))
    first = Window.partitionBy("doc_id", "at", "of").orderBy(
        (F.col("code") != "REFERENCE_UNVERIFIABLE").cast("int"), precedence, *ORDER
    )
    kept = keyed.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn", "at", "of")
    return rows.where(~is_reference).unionByName(kept)


def severity_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of all severities, zeros included, in total or for each group."""
    counted = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    return rows.groupBy(*by).agg(*counted) if by else rows.agg(*counted)


def gates(rows: DataFrame, fail_on: str = "error", fail_on_stale: bool = False) -> Column:
    """Whether a finding makes its run fail. What could not be verified never does, nor what is acknowledged."""
    levels = {"error": ("ERROR",), "warning": ("ERROR", "WARNING"), "info": ("ERROR", "WARNING", "INFO")}[fail_on]
    failing = F.col("severity").isin(*levels) & F.col("acknowledged").isNull()
    return failing | (F.col("code") == "BASELINE_STALE") if fail_on_stale else failing


def exit_codes(rows: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """doc_id, exit_code (0 or 1) of every document, also those without findings."""
    failed = rows.where(gates(rows, **options)).select("doc_id").distinct().withColumn("exit_code", F.lit(1))
    return documents.select("doc_id").distinct().join(failed, "doc_id", "left").select("doc_id", F.coalesce("exit_code", F.lit(0)).alias("exit_code"))


def tally(rows: DataFrame) -> DataFrame:
    """One row: totals by severity, how many gate, are acknowledged or stale."""
    return rows.agg(
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES],
        F.count(F.when(gates(rows), 1)).alias("gating"),
        F.count("acknowledged").alias("acknowledged"),
        F.count(F.when(F.col("code") == "BASELINE_STALE", 1)).alias("stale"),
    )


def tiers(spark: SparkSession) -> DataFrame:
    """code, tier_order, tier: where each code stands in the order of fixing."""
    rows = [(code, k, tier) for k, (tier, codes) in enumerate(TIERS) for code in codes]
    return spark.createDataFrame(rows, "code string, tier_order int, tier string")


def fix_order(rows: DataFrame, *by: str) -> DataFrame:
    """A row for each code: tier, severity (the highest among its findings), number; codes that no tier names come last."""
    highest = F.max_by("severity", F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("severity")])
    groups = rows.groupBy(*by, "code").agg(highest.alias("severity"), F.count("*").alias("findings"))
    placed = groups.join(F.broadcast(tiers(rows.sparkSession)), "code", "left")
    return placed.select(
        *by, "code", F.coalesce("tier_order", F.lit(len(TIERS))).alias("tier_order"), F.coalesce("tier", F.lit(OTHER)).alias("tier"), "severity", "findings"
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Findings with their label F1, F2, ... in report order within their document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER))
    return rows.withColumn("label", F.concat(F.lit("F"), n.cast("string")))


def chosen(rows: DataFrame, labels: list[str] | None = None, severities: tuple[str, ...] = ("ERROR", "WARNING"), code: str = "", first: int = 0) -> DataFrame:
    """Findings by label, else by severity and code, the first so many in report order."""
    marked = labelled(rows)
    kept = marked.where(F.col("label").isin(*labels)) if labels else marked.where(F.col("severity").isin(*severities))
    kept = kept.where(F.col("code") == code) if code and not labels else kept
    return kept.orderBy("doc_id", *ORDER).limit(first) if first else kept


def round_robin(rows: DataFrame, n: int, key: str = "severity", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Up to ``n`` rows, one of each group in turn."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", key).limit(n)


def fingerprint() -> Column:
    """Stable identity of a finding across runs."""
    return F.sha2(F.concat_ws("\x1f", "code", "location", "prop", F.col("rule.url"), F.col("rule.citation")), 256)


def attach_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Findings with file, line and column where the pointer's place is known.

    A location ``file#pointer`` is looked up in that file, any other in the finding's own document.
    """
    other = F.col("location").rlike("^[^/][^#]*#/")
    file = F.when(other, F.substring_index("location", "#", 1)).otherwise(F.col("doc_id"))
    pointer = F.when(other, F.regexp_replace("location", "^[^#]*#", "")).otherwise(F.col("location"))
    known = positions.select(F.col("doc_id").alias("_file"), F.col("pointer").alias("_pointer"), "line", "column")
    joined = rows.withColumns({"_f": file, "_p": pointer}).join(known, (F.col("_f") == F.col("_file")) & (F.col("_p") == F.col("_pointer")), "left")
    place = F.when(F.col("line").isNotNull(), F.struct(F.col("_file").alias("file"), F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column")))
    return joined.withColumn("position", place).select(*rows.columns)
