"""New rule data: read and refused as candidates, written over the old only when all of it fits, and shown as a difference.

Candidates are files that Spark reads whole; their digests, sizes and what refuses
them are columns. The held rule data is a folder with a manifest that names every file
with its digest. A write is staged: every name must stand in the manifest once and every
staged file must have its candidate's digest before any held file is replaced, and the
manifest is replaced last, so a write that fails leaves a folder whose manifest still
says what was there before.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import Refusal
from assayer.rules.pack import FORBIDDEN

MANIFEST, STAGED = "manifest.json", ".staged"
#: Changes of constraints in the order in which a difference lists them.
CHANGES = ("added", "removed", "releveled", "retargeted", "now evaluated", "now skipped")


def records(files: DataFrame) -> DataFrame:
    """name, sha256, size and refusal (null if there is none) of files (name, content): a file with a document type or an entity is not to be parsed."""
    marks = [F.when(F.contains("content", F.lit(m.encode())), F.lit(f"carries {m}")) for m in FORBIDDEN]
    return files.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), F.coalesce(*marks).alias("refusal"))


def candidate(spark: SparkSession, folder: str, names: Iterable[str]) -> DataFrame:
    """name and content of the named files of a folder; a file that is absent, or carries markup that a parser must not meet, refuses all."""
    wanted = sorted(set(names))
    read = spark.read.format("binaryFile").load(folder)
    files = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(F.col("name").isin(wanted))
    said = {r["name"]: r["refusal"] for r in records(files).select("name", "refusal").collect()}
    absent = [n for n in wanted if n not in said]
    bad = [f"{n} {why}" for n, why in sorted(said.items()) if why]
    if absent or bad:
        raise Refusal("the rule data cannot be used: " + "; ".join([f"{n} is absent" for n in absent] + bad))
    return files


def manifest_of(folder: str) -> list[dict[str, str]]:
    """The rows (name, sha256) of a folder's manifest."""
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        rows = json.load(f)
    if not isinstance(rows, list) or not all(isinstance(r, dict) and {"name", "sha256"} <= set(r) for r in rows):
        raise Refusal("the manifest cannot be read")
    return rows


def write(files: DataFrame, folder: str) -> list[str]:
    """Replaces held files by those of a candidate and returns their names; any mismatch is found before the first of them is touched."""
    rows = manifest_of(folder)
    named = [r["name"] for r in rows]
    moved = sorted((r.asDict() for r in files.join(records(files).select("name", "sha256"), "name").collect()), key=lambda r: r["name"])
    for r in moved:
        if named.count(r["name"]) != 1:
            raise Refusal(f"the manifest has {named.count(r['name'])} row(s) for {r['name']}; one is expected")
    staged = []
    try:
        for r in moved:
            staged.append(os.path.join(folder, r["name"] + STAGED))
            with open(staged[-1], "wb") as f:
                f.write(r["content"])
            with open(staged[-1], "rb") as f:
                if hashlib.sha256(f.read()).hexdigest() != r["sha256"]:
                    raise Refusal(f"{r['name']} was not written whole")
        digests = {r["name"]: r["sha256"] for r in moved}
        staged.append(os.path.join(folder, MANIFEST + STAGED))
        with open(staged[-1], "w", encoding="utf-8") as f:
            json.dump([r | {"sha256": digests.get(r["name"], r["sha256"])} for r in rows], f, indent=1)
        for path in staged:
            os.replace(path, path.removesuffix(STAGED))
    finally:
        for path in staged:
            if os.path.exists(path):
                os.unlink(path)
    return [r["name"] for r in moved]


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, before and after (digests; null where a side lacks the file) of files (name, sha256) that differ."""
    sides = old.select("name", F.col("sha256").alias("before")).join(new.select("name", F.col("sha256").alias("after")), "name", "full_outer")
    return sides.where(~F.col("before").eqNullSafe(F.col("after")))


def difference_lines(constraints: DataFrame, files: DataFrame) -> DataFrame:
    """part, n and lines: how many files and constraints changed in each way, and which; parts without a change are not there.

    ``constraints`` as ``compare_rules`` gives them, ``files`` as ``changed_files`` does.
    """
    short = lambda c: F.coalesce(F.substring(c, 1, 12), F.lit("(absent)"))
    moved = files.select(F.lit("files").alias("part"), F.concat("name", F.lit(": "), short("before"), F.lit(" -> "), short("after")).alias("line"))
    said = constraints.select(F.col("change").alias("part"), F.concat("identifier", F.lit(" ("), "rule_kind", F.lit(")")).alias("line"))
    return moved.unionByName(said).groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))


def difference_text(constraints: DataFrame, files: DataFrame, releases: tuple[str, str]) -> str:
    """The difference between two releases of rules as text, as long as the rules that changed."""
    found = {r["part"]: r for r in difference_lines(constraints, files).collect()}
    lines = [f"release: {releases[0]} -> {releases[1]}"]
    for part in ("files", *CHANGES):
        held = found[part]["lines"] if part in found else []
        lines += [f"{'files whose bytes differ' if part == 'files' else part}: {len(held)}", *(f"  {line}" for line in held)]
    if "files" in found and len(found) == 1:
        lines.append("  the bytes differ in ways that no constraint shows; read the files before calling the rules unchanged")
    return "\n".join(lines)
