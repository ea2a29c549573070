"""Many documents as one unit: totals, the import graph, what is missing and what collides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.findings import exit_codes, severity_counts


def totals(found: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, counts by severity and exit_code of every member; the worst exit code is the package's."""
    return exit_codes(found, documents).join(severity_counts(found, "doc_id"), "doc_id", "left").na.fill(0)


def verdict(member_totals: DataFrame) -> int:
    """The highest exit code of any member."""
    return member_totals.agg(F.max("exit_code")).first()[0] or 0


def import_graph(met: DataFrame) -> DataFrame:
    """Edges that a member states itself."""
    return met.where(F.col("doc_id") == F.col("primary")).drop("primary")


def not_in_package(met: DataFrame) -> DataFrame:
    """Own edges that nothing answers."""
    return import_graph(met).where(F.size("candidates") == 0)


def unreferenced(documents: DataFrame, met: DataFrame) -> DataFrame:
    """Members that no other member's import resolves to."""
    named = import_graph(met).where(F.col("resolved_to") != F.col("doc_id")).select(F.col("resolved_to").alias("doc_id")).distinct()
    return documents.select("doc_id").distinct().join(named, "doc_id", "left_anti")


def collisions(declared: DataFrame, member: str = "doc_id", value: str = "value") -> DataFrame:
    """value, members: identifiers that more than one member declares."""
    rows = declared.select(F.col(member).alias("member"), F.col(value).alias("value")).distinct()
    shared = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return rows.join(shared, "value").groupBy("value").agg(F.array_sort(F.collect_list("member")).alias("members"))
