"""Bookkeeping of evaluation runs: what was covered, shards put together, outcomes summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.errors import Refusal
from assayer.operators.compare import IDENTITY, compare, identified


def coverage(expected: DataFrame, covered: DataFrame, unit: str = "unit") -> DataFrame:
    """Expected units that nothing covers; a covered unit that was not expected refuses the whole."""
    strange = covered.select(unit).distinct().join(expected, unit, "left_anti").limit(5).collect()
    if strange:
        raise Refusal(f"units outside the expected set: {[r[0] for r in strange]}")
    return expected.select(unit).distinct().join(covered, unit, "left_anti")


def merge_shards(cases: DataFrame, provenance: DataFrame, key: list[str], may_differ: tuple[str, ...] = ("commit", "served_model")) -> DataFrame:
    """Cases of all shards; shards must agree on their provenance and not overlap.

    ``cases`` and ``provenance`` have the column shard; provenance has a row for each shard.
    """
    fields = [c for c in provenance.columns if c != "shard" and c not in may_differ]
    said = provenance.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in fields]).first()
    if split := [c for c in fields if said[c] > 1]:
        raise Refusal(f"shards disagree on {', '.join(split)}")
    if overlap := cases.groupBy(*key).agg(F.countDistinct("shard").alias("n")).where("n > 1").limit(1).collect():
        raise Refusal(f"shards overlap at {overlap[0].asDict()}")
    return cases


def missing_everywhere(missing: DataFrame, shards: int, unit: str = "unit") -> DataFrame:
    """Units that every one of ``shards`` shards reports as missing (columns shard and unit)."""
    return missing.groupBy(unit).agg(F.countDistinct("shard").alias("n")).where(F.col("n") == shards).select(unit)


def new_errors(found: DataFrame, before: DataFrame) -> DataFrame:
    """Errors whose identity the earlier run did not have."""
    keys = ["doc_id", *IDENTITY]
    return identified(found).where("severity = 'ERROR'").join(identified(before).select(*keys), keys, "left_anti")


def repair_outcomes(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, resolved, introduced, also_resolved, clean: what a change did to its target (doc_id, location, code), moves not paired."""
    compared = compare(before, after, pair_moves=False)
    gone = compared.where("status = 'removed'").select("before.doc_id", "before.location", "before.code")
    came = compared.where("status = 'added'").groupBy(F.col("after.doc_id").alias("doc_id")).agg(F.count("*").alias("introduced"))
    hit = targets.join(gone, ["doc_id", "location", "code"], "left_semi").select("doc_id").distinct().withColumn("resolved", F.lit(True))
    other = gone.join(targets, ["doc_id", "location", "code"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("also_resolved"))
    rows = targets.select("doc_id").distinct()
    for part in (hit, came, other):
        rows = rows.join(part, "doc_id", "left")
    resolved = F.coalesce("resolved", F.lit(False))
    introduced = F.coalesce("introduced", F.lit(0))
    return rows.select(
        "doc_id", resolved.alias("resolved"), introduced.alias("introduced"), F.coalesce("also_resolved", F.lit(0)).alias("also_resolved"),
        (resolved & (introduced == 0)).alias("clean"),
    )


def outcome_summary(records: DataFrame, by: str = "injector") -> DataFrame:
    """For each injector: cases, resolved, clean and how many brought in new findings."""
    yes = lambda c: F.count(F.when(F.col(c), 1))
    return records.groupBy(by).agg(
        F.count("*").alias("cases"), yes("resolved").alias("resolved"), yes("clean").alias("clean"), F.count(F.when(F.col("introduced") > 0, 1)).alias("introduced")
    )


def boundary_summary(records: DataFrame) -> DataFrame:
    """For each category: cases, held (neither the wording nor the judge objects), and the ids that did not hold."""
    held = ~F.col("lexical") & ~F.col("judged")
    return records.groupBy("category").agg(
        F.count("*").alias("cases"), F.count(F.when(held, 1)).alias("held"), F.array_sort(F.collect_list(F.when(~held, F.col("id")))).alias("crossed")
    )


def pinned(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (id, sha256) with their state: present, absent, or refused because the bytes differ."""
    joined = manifest.join(files.select("id", F.col("sha256").alias("found")), "id", "left")
    state = F.when(F.col("found").isNull(), "absent").when(F.col("found") == F.col("sha256"), "present").otherwise("refused")
    return joined.withColumn("state", state).drop("found")


def survey_summary(records: DataFrame) -> DataFrame:
    """One row: targets, those validated, with errors, with a complete model, and import edges with those resolved."""
    read = F.col("outcome").isin("fetched", "cached", "validated")
    return records.agg(
        F.count("*").alias("targets"), F.count(F.when(read, 1)).alias("validated"), F.count(F.when(~read, 1)).alias("not_read"),
        F.count(F.when(read & (F.col("errors") > 0), 1)).alias("with_errors"), F.count(F.when(read & F.col("complete"), 1)).alias("complete"),
        F.coalesce(F.sum("imports"), F.lit(0)).alias("import_edges"), F.coalesce(F.sum("imports_resolved"), F.lit(0)).alias("import_edges_resolved"),
    )


def example_locations(found: DataFrame) -> DataFrame:
    """For each code the first location in report order, and how many findings carry it."""
    return found.groupBy("code").agg(F.min(F.struct("doc_id", "location")).alias("e"), F.count("*").alias("n")).select("code", "e.doc_id", "e.location", "n")


def grounding(claims: DataFrame) -> DataFrame:
    """unit, claims, verified, withheld, faithful (nothing withheld) of judged quotations (unit, verdict)."""
    good = F.col("verdict") == "ok"
    counted = claims.groupBy("unit").agg(F.count("*").alias("claims"), F.count(F.when(good, 1)).alias("verified"), F.count(F.when(~good, 1)).alias("withheld"))
    return counted.withColumn("faithful", F.col("withheld") == 0)
