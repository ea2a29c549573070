"""Explanations, answers and repairs over recorded replies, for many findings at once.

No model is called: a prompt is looked up among recorded replies by its digest, and
what its reply says is checked before it is shown. What cannot be answered is
skipped with its reason and never filled in.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.errors import Refusal
from assayer.operators import assist, findings, patch, scoring, texts
from assayer.plans.validate import validate
from assayer.rules.pack import RulePack

REPLY = "struct<text:string,quotes:array<struct<id:string,source:string,text:string>>>"
NO_EVIDENCE, NO_REPLY, NO_OBJECT = "no source text matches", "no reply is recorded for this prompt", "the reply holds no readable object"


def answered(asked: DataFrame, passages: DataFrame, cassettes: DataFrame, guard: texts.Guard, k: int = 2) -> DataFrame:
    """ask_id, prompt, prose, quotes, withheld, sentences, skipped of what is asked (ask_id, head, query).

    ``passages`` has source, label, passage; ``cassettes`` prompt_sha256 and reply. Without
    evidence there is no prompt; every ask has one row whatever becomes of it.
    """
    shown = texts.evidence(asked.select(F.col("ask_id").alias("query_id"), "query"), passages, k)
    one = F.struct("place", F.concat(F.lit("["), "source", F.lit(" "), "label", F.lit("] "), "shown").alias("line"))
    held = shown.groupBy(F.col("query_id").alias("ask_id")).agg(F.array_sort(F.collect_list(one)).alias("held"))
    prompts = asked.join(held, "ask_id", "left").withColumn("prompt", F.when(F.col("held").isNotNull(), F.concat("head", F.lit("\n"), F.array_join("held.line", "\n"))))
    keyed = prompts.select("ask_id", "prompt", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))
    read = keyed.join(cassettes.select("prompt_sha256", "reply"), "prompt_sha256", "left").withColumn("said", F.from_json(texts.reply_json(F.col("reply")), REPLY))
    skipped = F.when(F.col("prompt").isNull(), NO_EVIDENCE).when(F.col("reply").isNull(), NO_REPLY).when(F.col("said.text").isNull(), NO_OBJECT)
    read = read.select("ask_id", "prompt", "said", skipped.alias("skipped"))
    none = F.array().cast("array<struct<id:string,source:string,text:string>>")
    replies = read.where("skipped IS NULL").select(F.col("ask_id").alias("reply_id"), F.col("said.text").alias("prose"), F.coalesce("said.quotes", none).alias("quotes"))
    checked = assist.verify(replies, passages.select("source", F.col("passage").alias("text")), guard).withColumnRenamed("reply_id", "ask_id")
    return read.drop("said").join(checked, "ask_id", "left").select("ask_id", "prompt", "prose", "quotes", "withheld", "sentences", "skipped")


def explain(found: DataFrame, passages: DataFrame, cassettes: DataFrame, guard: texts.Guard) -> DataFrame:
    """An answer for each finding (ask_id is its document and label) with the notes that belong beside it."""
    marked = assist.notes(findings.labelled(found)).withColumn("ask_id", F.concat_ws("#", "doc_id", "label"))
    line = F.concat_ws(" ", "severity", "code", F.concat(F.lit("at="), "location"), F.concat("prop", F.lit("="), "value"), "message")
    asked = marked.select("ask_id", F.concat(F.lit("Explain this finding: "), line).alias("head"), F.concat_ws(" ", "message", "prop", "rule.citation").alias("query"))
    said = answered(asked, passages, cassettes, guard)
    return said.join(marked.select("ask_id", "doc_id", "label", "code", "location", "notes"), "ask_id")


def ask(questions: DataFrame, found: DataFrame, passages: DataFrame, cassettes: DataFrame, guard: texts.Guard) -> DataFrame:
    """An answer for each question (ask_id, doc_id, question), asked beside the findings of its document."""
    told = questions.join(assist.context(found), "doc_id", "left")
    head = F.concat(F.lit("Question: "), "question", F.lit("\nFindings:\n"), F.coalesce("context", F.lit("(none)")))
    return answered(told.select("ask_id", head.alias("head"), F.col("question").alias("query")), passages, cassettes, guard)


def repair(documents: DataFrame, proposals: DataFrame, pack: RulePack, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The proposals (doc_id, patch) with the patched text or why it is refused, and what each that applies does to its target (doc_id, location, code).

    A patch whose values a person still has to write is refused. Documents are judged
    before and after with all others as they were.
    """
    tried = documents.join(proposals, "doc_id").withColumn("p", patch.patched(F.col("text"), F.col("patch")))
    unfinished = F.size(patch.placeholders(F.from_json("patch", patch.OPERATION))) > 0
    refused = F.coalesce(F.col("p.error"), F.when(F.coalesce(unfinished, F.lit(False)), "a value is still to be written"))
    rows = tried.select("doc_id", F.when(refused.isNull(), F.col("p.text")).alias("text"), refused.alias("refused"))
    mine = rows.where("refused IS NULL")
    after = documents.join(mine.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text").unionByName(mine.select("doc_id", "text"))
    primaries = mine.select("doc_id")
    outcomes = scoring.repair_outcomes(validate(documents, pack, primaries), validate(after, pack, primaries), targets.join(primaries, "doc_id", "left_semi"))
    return rows, outcomes


def answer_text() -> Column:
    """An answer for readers: the prose or why there is none, then quotations, what was withheld, and notes."""
    quoted = F.transform("quotes", lambda q: F.concat(F.lit("  ["), q["id"], F.lit("] "), q["source"], F.lit(": "), q["quote"]))
    withheld = F.transform("withheld", lambda w: F.concat(F.lit("  withheld ["), w["id"], F.lit("]: "), w["reason"]))
    struck = F.transform("sentences", lambda s: F.concat(F.lit("  withheld sentence: "), s))
    parts = [F.coalesce("prose", F.concat(F.lit("skipped: "), "skipped")), *[F.array_join(x, "\n") for x in (quoted, withheld, struck)]]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def write_out(path: str, text: str, originals: list[str]) -> None:
    """Writes a repaired document, but never over a file that the run has read."""
    if Path(path).resolve() in {Path(p).resolve() for p in originals}:
        raise Refusal(f"{path} is a file that this run reads, and is not written over")
    Path(path).write_text(text, encoding="utf-8")
