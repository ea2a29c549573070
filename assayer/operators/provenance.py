"""Where rules come from: constraints by identifier, codes with what they report, and the words of declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.checks import rules_table
from assayer.operators.texts import quoted_there
from assayer.rules.pack import RulePack

#: What each finding code reports and which check gives it.
CODES = (
    ("ARRAY_TOO_SHORT", "structure", "an array has fewer items than the schema allows"),
    ("BASELINE_STALE", "baseline", "a baseline entry names a finding that is not reported any more"),
    ("CONSTRAINT_CARDINALITY", "constraints", "too few or too many nodes stand where a constraint counts them"),
    ("CONSTRAINT_NOT_EVALUATED", "constraints", "constraints of a kind were not evaluated"),
    ("CONSTRAINT_NOT_UNIQUE", "constraints", "two nodes share a key that must be unique"),
    ("CONSTRAINT_VALUE_MISMATCH", "constraints", "a value does not match a declared pattern"),
    ("DATATYPE_BELOW_MINIMUM", "datatypes", "a number is below the minimum of its datatype"),
    ("DATATYPE_MISMATCH", "datatypes", "a value does not match the pattern of its datatype"),
    ("IMPORT_AMBIGUOUS", "imports", "an import matched several supplied documents"),
    ("IMPORT_NOT_SUPPLIED", "imports", "an import matched no supplied document"),
    ("IMPORT_RESOLVED", "imports", "an import matched one supplied document"),
    ("NO_SCHEMA_ALTERNATIVE", "structure", "an object fits none of the alternatives of the schema"),
    ("OSCAL_VERSION_DIFFERS", "versions", "the document declares another release than that of the rules"),
    ("PATTERN_NOT_CHECKED", "datatypes", "values whose pattern cannot be applied were not checked"),
    ("PROPERTY_UNDECLARED", "structure", "a property is present that the schema does not declare"),
    ("REFERENCE_UNRESOLVED", "references", "a reference names an identifier that nothing declares"),
    ("REFERENCE_UNVERIFIABLE", "references", "a reference could not be settled with the supplied documents"),
    ("REQUIRED_PROPERTY_MISSING", "structure", "a property that the schema requires is absent"),
    ("SUBTREE_NOT_READ", "structure", "a part of the document could not be read by the schema"),
    ("TYPE_MISMATCH", "structure", "a value has another JSON type than the schema declares"),
    ("UUID_NOT_UNIQUE", "identifiers", "two objects of a document carry one UUID"),
    ("VERSION_SKEW_SUSPECTED", "versions", "errors rest on another release than the document declares"),
)


def codes(spark: SparkSession) -> DataFrame:
    """code, emitted_by, reports."""
    return spark.createDataFrame(list(CODES), "code string, emitted_by string, reports string")


def constraints_by_id(spark: SparkSession, pack: RulePack, identifier: str) -> DataFrame:
    """All declarations that carry an identifier."""
    return rules_table(spark, pack).where(F.col("identifier") == identifier)


def coverage_table(spark: SparkSession, pack: RulePack, kind: str = "", evaluated: bool | None = None) -> DataFrame:
    """kind, published, evaluated, reasons of the chosen constraints; both totals are always there."""
    rows = rules_table(spark, pack)
    rows = rows.where(F.col("rule_kind") == kind) if kind else rows
    if evaluated is not None:
        rows = rows.where((F.col("skipped") == "") == F.lit(evaluated))
    return coverage_of(rows)


def coverage_of(declared: DataFrame) -> DataFrame:
    """The same figures of declared constraints in a table of any size (columns rule_kind and skipped)."""
    return declared.groupBy(F.col("rule_kind").alias("kind")).agg(
        F.count("*").alias("published"), F.count(F.when(F.col("skipped") == "", 1)).alias("evaluated"),
        F.array_sort(F.collect_set(F.when(F.col("skipped") != "", F.col("skipped")))).alias("reasons"),
    )


def declaration(module: Column, kind: str, identifier: str) -> Column:
    """The element that declares an identifier, word for word; null if the module has none."""
    pattern = rf'(?s)<{kind}\b(?=[^>]*\bid="{identifier}")[^>]*?(?:/>|>.*?</{kind}>)'
    return F.nullif(F.regexp_extract(module, pattern, 0), F.lit(""))


def rules_of_codes(spark: SparkSession, pack: RulePack) -> DataFrame:
    """code, emitted_by, reports, citation, url, retrieved: every code with the rule that the pack cites for it, blank if it cites none."""
    rows = [(code, *[held.get(k, "") for k in ("citation", "url", "retrieved")]) for code, held in pack.citations.items()]
    cited = spark.createDataFrame(rows, "code string, citation string, url string, retrieved string")
    return codes(spark).join(F.broadcast(cited), "code", "left").na.fill("", ["citation", "url", "retrieved"])


def quotations(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """id, source, quote, state, source_sha256 of quotations (id, source, quote): what stands in its source carries that text's digest.

    A source without text here is said to be absent, never taken as confirmed.
    """
    there = sources.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))
    held = quoted_there(asked.select(F.col("id").alias("quote_id"), "source", "quote"), sources).select(F.col("quote_id").alias("id"), "source", F.lit(True).alias("held"))
    rows = asked.join(there, "source", "left").join(held, ["id", "source"], "left")
    state = (
        F.when(F.col("source_sha256").isNull(), "no text of this source is held").when(F.col("held").isNull(), "the words do not stand in the source").otherwise("quoted")
    )
    return rows.select("id", "source", "quote", state.alias("state"), "source_sha256")


def digests(binaries: DataFrame) -> DataFrame:
    """path and SHA-256 of files as ``binaryFile`` reads them."""
    return binaries.select("path", F.sha2("content", 256).alias("sha256"))
