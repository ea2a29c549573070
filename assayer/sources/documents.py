"""Documents as one row a file, whatever store the paths are in."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import Refusal


def expand(paths: Iterable[str]) -> list[str]:
    """Files of the given paths: a file itself, of a folder the .json files directly in it, each place once, sorted by folder."""
    found: dict[str, str] = {}
    for path in paths:
        if os.path.isdir(path):
            listed = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".json"))
        elif os.path.isfile(path):
            listed = [path]
        else:
            raise Refusal(f"{path}: no such file or folder")
        for file in listed:
            found.setdefault(os.path.realpath(file), file)
    return list(found.values())


def discover(patterns: Iterable[str]) -> list[str]:
    """Files below folders, of glob patterns, or named; a pattern without a match is refused."""
    found: dict[str, None] = {}
    for pattern in patterns:
        if os.path.isdir(pattern):
            listed = sorted(glob.glob(os.path.join(pattern, "**", "*.json"), recursive=True))
        else:
            listed = sorted(glob.glob(pattern, recursive=True)) or ([pattern] if os.path.exists(pattern) else [])
        if not listed:
            raise Refusal(f"{pattern}: nothing matches")
        found |= dict.fromkeys(listed)
    return list(found)


def inside(path: str, root: str) -> str:
    """The real path of a file, refused if it is not below ``root`` once links are followed."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise Refusal(f"{path} is outside {root}")
    return real


def read_documents(spark: SparkSession, paths: list[str] | str, recursive: bool = False, pattern: str = "*.json") -> DataFrame:
    """doc_id (the path) and text of whole files. Folders are read by Spark, so any store that it knows will do."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    rows = reader.text(paths, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_path", "^file:(?://)?", "").alias("doc_id"), F.col("value").alias("text"))


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Documents that are in memory already."""
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")
