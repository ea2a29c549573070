"""Two runs compared: what is removed, added, changed, moved or the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.operators.findings import ORDER

IDENTITY = ("code", "location", "prop", "citation")
DISPLACED = ("code", "prop", "value", "citation")
COMPARED = ("value", "severity", "message", "rule", "suggestions", "acknowledged", "position")


def identified(rows: DataFrame) -> DataFrame:
    """One row an identity, the last in report order if it occurs again."""
    cited = rows.withColumn("citation", F.col("rule.citation"))
    last = Window.partitionBy("doc_id", *IDENTITY).orderBy(*[F.col(c).desc() for c in ORDER])
    return cited.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn")


def differs(a: str, b: str) -> Column:
    """Whether two findings of one identity differ in anything."""
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return ~same


def compare(before: DataFrame, after: DataFrame, pair_moves: bool = True) -> DataFrame:
    """status, before, after (structs; null on the side where there is none) of every identity of either run.

    A removed and an added finding are one that moved only if each is alone with
    its code, property, value and citation; where several could be paired, none
    is, and ``undecided`` says so.
    """
    a, b = (identified(x) for x in (before, after))
    keys = ["doc_id", *IDENTITY]
    left = a.select(*keys, F.struct(*a.columns).alias("before"))
    right = b.select(*keys, F.struct(*b.columns).alias("after"))
    joined = left.join(right, [left[k].eqNullSafe(right[k]) for k in keys], "full_outer").select("before", "after")
    status = (
        F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(differs("before", "after"), "changed").otherwise("unchanged")
    )
    whole = joined.withColumn("status", status).withColumn("undecided", F.lit(False))
    if not pair_moves:
        return whole
    one_sided = whole.where(F.col("status").isin("removed", "added")).withColumn("f", F.coalesce("before", "after"))
    group = Window.partitionBy(F.col("f.doc_id"), *[F.col(f"f.{c}") for c in DISPLACED])
    # A pair is put together in the row of what is gone, so the join of the runs is not made once more for it.
    one_sided = one_sided.withColumns({
        "gone": F.count("before").over(group), "new": F.count("after").over(group), "was": F.max("before").over(group), "now": F.max("after").over(group),
    })
    paired = (F.col("gone") == 1) & (F.col("new") == 1)
    one_sided = one_sided.where(~paired | F.col("after").isNull()).withColumns({
        "before": F.when(paired, F.col("was")).otherwise(F.col("before")), "after": F.when(paired, F.col("now")).otherwise(F.col("after")),
        "status": F.when(paired, "moved").otherwise(F.col("status")), "undecided": ~paired & (F.col("gone") > 0) & (F.col("new") > 0),
    })
    columns = ["before", "after", "status", "undecided"]
    return whole.where(~F.col("status").isin("removed", "added")).select(*columns).unionByName(one_sided.select(*columns))


def new_errors(compared: DataFrame) -> DataFrame:
    """Added errors; one that moved is not new."""
    return compared.where((F.col("status") == "added") & (F.col("after.severity") == "ERROR"))


def changes(compared: DataFrame) -> DataFrame:
    """doc_id, location, field, before, after for every field that changed under one identity; ``(none)`` if it was absent."""
    rows = compared.where("status = 'changed'")
    fields = {"value": "value", "severity": "severity", "message": "message", "source": "rule.url", "acknowledgment": "acknowledged.reason"}
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"before.{p}").alias("before"), F.col(f"after.{p}").alias("after")) for n, p in fields.items()
    ])).alias("c")
    rows = rows.select(F.col("after.doc_id").alias("doc_id"), F.col("after.location").alias("location"), F.col("after.code").alias("code"), each)
    rows = rows.where(~F.col("c.before").eqNullSafe(F.col("c.after")))
    none = F.lit("(none)")
    return rows.select("doc_id", "location", "code", "c.field", F.coalesce("c.before", none).alias("before"), F.coalesce("c.after", none).alias("after"))


def summary(compared: DataFrame, *by: str) -> DataFrame:
    """How many identities have each status."""
    counted = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("removed", "added", "changed", "moved", "unchanged")]
    return compared.groupBy(*by).agg(*counted) if by else compared.agg(*counted)


def positional(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``occurrence``: their number among rows of the same key, so that repeated keys can be compared."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def compare_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """Declared constraints of two packs (as ``rules_table`` gives them): added, removed, releveled, retargeted, now evaluated or now skipped."""
    key = ["rule_kind", "identifier", "declared_on"]
    a, b = (positional(x, key, ["rule"]) for x in (before, after))
    left = a.select(*key, "occurrence", F.struct("severity", "target", "skipped").alias("old"))
    right = b.select(*key, "occurrence", F.struct("severity", "target", "skipped").alias("new"))
    rows = left.join(right, [*key, "occurrence"], "full_outer")
    said = F.array_compact(F.array(
        F.when(F.col("old").isNull(), F.lit("added")), F.when(F.col("new").isNull(), F.lit("removed")),
        F.when(F.col("old.severity") != F.col("new.severity"), F.lit("releveled")), F.when(F.col("old.target") != F.col("new.target"), F.lit("retargeted")),
        F.when((F.col("old.skipped") != "") & (F.col("new.skipped") == ""), F.lit("now evaluated")),
        F.when((F.col("old.skipped") == "") & (F.col("new.skipped") != ""), F.lit("now skipped")),
    ))
    return rows.select(*key, "occurrence", F.explode(said).alias("change"))


def provenance_notes(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str]]:
    """side and note: what a reader must know before two runs are compared; ``tool`` and ``rules`` say what each rests on, blank if unknown."""
    notes = []
    if before["tool"] != after["tool"]:
        notes.append(("before", f"written by {before['tool'] or 'an unknown version'}, the other by {after['tool'] or 'an unknown version'}"))
    for side, held in (("before", before), ("after", after)):
        if not held["rules"]:
            notes.append((side, "its rules are not recorded"))
    if before["rules"] and after["rules"] and before["rules"] != after["rules"]:
        notes.append(("after", f"judged by {after['rules']}, the other by {before['rules']}"))
    return notes


def notes_of_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """``key``, side and note of many pairs of runs (columns before and after, each with tool and rules); the same notes as of a single pair."""
    tool = lambda side: F.coalesce(F.nullif(F.col(f"{side}.tool"), F.lit("")), F.lit("an unknown version"))
    there = lambda side: F.coalesce(F.col(f"{side}.rules"), F.lit("")) != ""
    note = lambda side, *parts: F.struct(F.lit(side).alias("side"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("note"))
    said = F.array_compact(F.array(
        F.when(~F.col("before.tool").eqNullSafe(F.col("after.tool")), note("before", "written by ", tool("before"), ", the other by ", tool("after"))),
        *[F.when(~there(side), note(side, "its rules are not recorded")) for side in ("before", "after")],
        F.when(there("before") & there("after") & (F.col("before.rules") != F.col("after.rules")), note("after", "judged by ", F.col("after.rules"), ", the other by ", F.col("before.rules"))),
    ))
    return pairs.select(key, F.explode(said).alias("n")).select(key, "n.side", "n.note")


def hash_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) of rule files (path, sha256) whose bytes differ."""
    a, b = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def rules_unchanged(constraints: DataFrame, files: DataFrame, releases: tuple[str, str]) -> bool:
    """Whether two releases of rules are the same: no constraint, no file and not the release differs."""
    return releases[0] == releases[1] and constraints.isEmpty() and files.isEmpty()
