"""Surveys of many documents, and what a change of rules would move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.durable import cut
from assayer.operators import compare, findings, imports
from assayer.operators.evaluate import evaluate
from assayer.plans.validate import validate
from assayer.rules.pack import RulePack


def survey(targets: DataFrame, supporting: DataFrame, pack: RulePack) -> tuple[DataFrame, DataFrame]:
    """A record for each target (doc_id, text) and all findings; a target that cannot be read is recorded, an unreadable supporting document refuses the run."""
    documents = targets.select("doc_id", "text").unionByName(supporting.select("doc_id", "text")).dropDuplicates(["doc_id"])
    facts = cut(evaluate(documents, pack, ("error", "model", "scalar")))
    mine = targets.select("doc_id").distinct()
    bad = cut(facts.where("kind = 'error'").join(mine, "doc_id", "left_semi").select("doc_id", "detail"))
    good = mine.join(bad, "doc_id", "left_anti")
    read = documents.join(bad, "doc_id", "left_anti")
    found = cut(validate(read, pack, good))
    met, _ = imports.closure(good, facts.where("kind = 'scalar'").join(bad, "doc_id", "left_anti"), read)
    own = met.groupBy(F.col("primary").alias("doc_id")).agg(F.count("*").alias("imports"), F.count("resolved_to").alias("imports_resolved"))
    counts = findings.severity_counts(found, "doc_id")
    codes = found.groupBy("doc_id", "code").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    models = facts.where("kind = 'model'").select("doc_id", F.col("name").alias("model"))
    rows = good
    for part in (models, counts, codes, own, imports.completeness(good, met).select("doc_id", "complete")):
        rows = rows.join(part, "doc_id", "left")
    rows = rows.na.fill(0, ["imports", "imports_resolved", *findings.SEVERITIES])
    rows = rows.withColumns({"outcome": F.lit("validated"), "reason": F.lit(None).cast("string"), "errors": F.col("ERROR")})
    missing = bad.select("doc_id", F.lit("not read").alias("outcome"), F.col("detail").alias("reason"))
    return rows.unionByName(missing, allowMissingColumns=True), found


def rule_impact(documents: DataFrame, old: RulePack, new: RulePack) -> DataFrame:
    """doc_id, code, removed, added, changed, moved, unchanged: what other rules would do to the findings of documents."""
    compared = compare.compare(validate(documents, old), validate(documents, new))
    side = F.coalesce("after", "before")
    rows = compared.select(side["doc_id"].alias("doc_id"), side["code"].alias("code"), "status")
    return compare.summary(rows, "doc_id", "code").where("removed + added + changed + moved > 0")
