"""From raw documents to training text: language, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``,
but for the last, which returns the digests of the encoded texts. Between stages
the rows are written to the shared checkpoint folder, so no stage is computed
twice and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, decontaminate, language_id, personal_data, simhash
from assayer.llm.base import cut, load
from assayer.llm.queries import tokenizer_path
from assayer.llm.vocabulary import read_vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it taken out of their texts."""
    return personal_data.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document and of their decoding."""
    return bpe.round_trip(docs, read_vocabulary(tokenizer_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("personal_data", no_personal_data),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs


#: Language, fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None
