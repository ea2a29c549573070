"""The whole run: documents in, findings out, for one document or many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.durable import cut
from assayer.errors import Refusal
from assayer.operators import checks, findings, imports, suggest
from assayer.operators.evaluate import evaluate
from assayer.rules.pack import RulePack


def refuse_unreadable(facts: DataFrame) -> None:
    """A refusal that names up to twenty documents that cannot be read, and counts all."""
    bad = facts.where("kind = 'error'").select("doc_id", "detail")
    shown = bad.orderBy("doc_id").limit(20).collect()
    if shown:
        raise Refusal(f"{bad.count()} document(s) cannot be read: " + "; ".join(f"{r['doc_id']}: {r['detail']}" for r in shown))


def validate(documents: DataFrame, pack: RulePack, primaries: DataFrame | None = None, with_suggestions: bool = False) -> DataFrame:
    """Findings of the primaries (doc_id; all documents if not given), each judged with all other documents supplied.

    The facts are written to the shared folder once, for all checks to read. Each check is a job of its own whose
    findings are cut, so no plan holds all of them at once.
    """
    facts = cut(evaluate(documents, pack))
    refuse_unreadable(facts)
    mine = (documents if primaries is None else primaries).select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    own = facts.join(mine, "doc_id", "left_semi") if primaries is not None else facts
    scalars = facts.where("kind = 'scalar'")
    met, reached = imports.closure(mine, scalars, documents.select(F.col("doc_id").cast("string").alias("doc_id")))
    complete = cut(imports.completeness(mine, met))
    refs = checks.references(facts, reached, complete)
    parts = [
        imports.import_findings(met),
        checks.structure(own),
        checks.datatypes(own, pack),
        checks.constraints(facts, pack, reached, complete).join(mine, "doc_id", "left_semi"),
        checks.identifiers(own),
        suggest.with_suggestions(cut(refs), facts, reached) if with_suggestions else refs,
        checks.versions(own, pack),
    ]
    found = findings.union([cut(p) for p in parts]).join(mine, "doc_id", "left_semi")
    merged = cut(findings.merge_references(found))
    skew = findings.as_findings(checks.version_skew(own, pack, merged))
    return findings.finalize(findings.cited(findings.as_findings(merged).unionByName(skew), pack.citations))
