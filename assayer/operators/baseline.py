"""Acknowledged findings: a reviewed list that marks findings and never hides them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.errors import Refusal
from assayer.operators.findings import as_findings, rule

KEY = ("code", "location", "property", "value")
ENTRY = "code string, location string, property string, value string, reason string, acknowledged_on string"
VERSION = 1


def check_entries(entries: DataFrame) -> DataFrame:
    """The entries, or a refusal: every field must be written, dates must exist, and no finding may be acknowledged twice."""
    blank = F.lit(False)
    for c in (*KEY, "reason", "acknowledged_on"):
        blank = blank | F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    if blank_rows := entries.where(blank).limit(1).collect():
        raise Refusal(f"a baseline entry has a blank field: {blank_rows[0].asDict()}")
    dated = F.col("acknowledged_on").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp("acknowledged_on", F.lit("yyyy-MM-dd")).isNotNull()
    if wrong := entries.where(~dated).limit(1).collect():
        raise Refusal(f"a baseline entry has no date of the form YYYY-MM-DD: {wrong[0].asDict()}")
    if twice := entries.groupBy(*KEY).count().where("count > 1").limit(1).collect():
        raise Refusal(f"two baseline entries acknowledge one finding: {twice[0].asDict()}")
    return entries


def _keyed(entries: DataFrame) -> DataFrame:
    renamed = {c: f"b_{c}" for c in entries.columns}
    return entries.withColumnsRenamed(renamed)


def _same():
    pairs = zip(("code", "location", "prop", "value"), KEY, strict=True)
    same = F.lit(True)
    for mine, theirs in pairs:
        same = same & F.col(mine).eqNullSafe(F.col(f"b_{theirs}"))
    return same


def apply(found: DataFrame, entries: DataFrame) -> DataFrame:
    """All findings, acknowledged where an entry names them, and one BASELINE_STALE for each entry that names none."""
    keyed = _keyed(entries)
    refused = found.where("severity = 'UNVERIFIABLE'").join(keyed, _same(), "left_semi").limit(1).collect()
    if refused:
        raise Refusal(f"a baseline cannot acknowledge what was not settled: {refused[0]['code']} at {refused[0]['location']}")
    given = F.struct(F.col("b_reason").alias("reason"), F.col("b_acknowledged_on").alias("acknowledged_on"))
    marked = found.drop("acknowledged").join(keyed, _same(), "left").withColumn("acknowledged", F.when(F.col("b_reason").isNotNull(), given))
    return as_findings(marked).unionByName(stale(found, entries))


def stale(found: DataFrame, entries: DataFrame) -> DataFrame:
    """A warning for every entry that matches no finding."""
    unmatched = _keyed(entries).join(found, _same(), "left_anti")
    return as_findings(unmatched.select(
        F.lit("BASELINE_STALE").alias("code"), F.lit("WARNING").alias("severity"), F.col("b_location").alias("location"), F.col("b_property").alias("prop"),
        F.col("b_value").alias("value"), F.concat(F.lit("No finding "), "b_code", F.lit(" is reported here any more, so this entry acknowledges nothing.")).alias("message"),
        rule("an acknowledgment names a finding of the run").alias("rule"),
    ))


def draft(found: DataFrame) -> DataFrame:
    """Blank entries for a person to fill in: one for each finding that could be acknowledged."""
    rows = found.where("severity != 'UNVERIFIABLE'").select("code", "location", F.col("prop").alias("property"), "value").distinct()
    return rows.withColumns({"reason": F.lit(""), "acknowledged_on": F.lit("")})


def counts(found: DataFrame) -> DataFrame:
    """acknowledged and stale, counted on the findings that are shown."""
    return found.agg(F.count("acknowledged").alias("acknowledged"), F.count(F.when(F.col("code") == "BASELINE_STALE", 1)).alias("stale"))
