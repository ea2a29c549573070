"""The checkable parts of assistance: what is shown to a model, and what of its reply may be shown.

No model is called here. Replies are rows; quotations must stand word for word in
a known source, labels must exist, and sentences that pass a verdict are withheld.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.errors import Refusal
from assayer.operators import texts
from assayer.operators.findings import ORDER
from assayer.operators.patch import resolve

SHOWN_FINDINGS, EXCERPT = 40, 1800
LABEL = r"\b([FG][0-9]+)\b"
STRUCK = "[label struck: not a finding of the run]"


def _excerpt_of(text: str, location: str, limit: int) -> str | None:
    """JSON of the object that holds a location, or of the nearest one above that is there."""
    value = json.loads(text)
    way = location
    while way:
        way = way.rpartition("/")[0]
        try:
            return json.dumps(resolve(value, way), indent=1, ensure_ascii=False)[:limit]
        except Refusal:
            continue
    return None


def excerpts(found: DataFrame, documents: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """doc_id, location, excerpt: the part of the document around each finding."""
    rows = found.select("doc_id", "location").distinct().join(documents.select("doc_id", "text"), "doc_id")

    def run(batches):
        for batch in batches:
            made = [_excerpt_of(t, w, limit) for t, w in zip(batch["text"], batch["location"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "location": batch["location"], "excerpt": made})

    return rows.mapInPandas(run, "doc_id string, location string, excerpt string")


def context(found: DataFrame, shown: int = SHOWN_FINDINGS) -> DataFrame:
    """doc_id and context: the first findings of each document with their labels, and how many more there are."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER))
    line = F.concat(F.lit("F"), F.col("n").cast("string"), F.lit("  "), "severity", F.lit(" "), "code", F.lit(" at="), "location", F.lit(" "), "prop", F.lit("="), "value")
    rows = found.withColumn("n", n)
    first = rows.where(F.col("n") <= shown).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    total = rows.groupBy("doc_id").agg(F.max("n").alias("total"))
    more = F.when(F.col("total") > shown, F.array(F.concat(F.lit("... and "), (F.col("total") - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return first.join(total, "doc_id").select("doc_id", F.array_join(F.concat(F.col("l.line"), more), "\n").alias("context"))


def notes(found: DataFrame) -> DataFrame:
    """The findings with ``notes``: what has to be said beside each of them."""
    said = F.array_compact(F.array(
        F.when(F.col("severity") == "UNVERIFIABLE", F.lit("This was not decided either way; it is neither a pass nor a failure.")),
        F.when(F.col("code").isin("OSCAL_VERSION_DIFFERS", "VERSION_SKEW_SUSPECTED"), F.lit("The document declares another release than that of the rules.")),
        F.when(F.coalesce(F.col("rule.url") == "", F.lit(True)), F.lit("The rule is a policy of this engine and has no published source.")),
    ))
    return found.withColumn("notes", said)


def replay(prompts: DataFrame, cassettes: DataFrame) -> DataFrame:
    """Recorded replies (prompt_sha256, reply) of prompts (prompt_id, prompt); a prompt that was never recorded is refused."""
    keyed = prompts.withColumn("prompt_sha256", F.sha2(F.col("prompt").cast("binary"), 256))
    missing = keyed.join(cassettes, "prompt_sha256", "left_anti").limit(3).collect()
    if missing:
        raise Refusal(f"no recorded reply for {[r['prompt_id'] for r in missing]}")
    return keyed.join(cassettes, "prompt_sha256").select("prompt_id", "reply")


def verify(replies: DataFrame, sources: DataFrame, guard: texts.Guard) -> DataFrame:
    """reply_id, prose, quotes, withheld, sentences of replies (reply_id, prose, quotes as id, source, text) against sources (source, text).

    In this order: quotations are looked up, markers of others are struck, inline
    quotations that no source holds are struck, judging sentences are withheld.
    """
    each = replies.select("reply_id", F.explode("quotes").alias("q")).select("reply_id", "q.id", "q.source", F.trim("q.text").alias("quote"))
    each = each.withColumn("quote_id", F.concat_ws("\x1f", F.col("reply_id").cast("string"), "id", "source"))
    judged = each.join(texts.verified_quotes(each.select("quote_id", "source", "quote"), sources), "quote_id")
    good, state = F.col("verdict") == "ok", F.struct("id", "source", F.col("verdict").alias("reason"))
    lists = judged.groupBy("reply_id").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("id", "source", "quote")))).alias("quotes"), F.array_sort(F.collect_list(F.when(~good, state))).alias("withheld")
    )
    inline = replies.select("reply_id", F.explode(F.array_distinct(texts.inline_quotes(F.col("prose")))).alias("quote"))
    inline = inline.withColumn("quote_id", F.sha2(F.col("quote").cast("binary"), 256))
    held = texts.quoted_in(inline.select("quote_id", "quote").distinct(), sources).select("quote_id").distinct()
    held = inline.join(held, "quote_id", "left_semi").groupBy("reply_id").agg(F.collect_set("quote").alias("held"))
    rows = replies.select("reply_id", "prose").join(lists, "reply_id", "left").join(held, "reply_id", "left")
    none = F.array().cast("array<string>")
    known = F.coalesce(F.transform("quotes", lambda q: q["id"]), none)
    struck = texts.strike_inline(texts.strike_markers(F.col("prose"), known), F.coalesce("held", none))
    rows = rows.withColumn("prose", struck)
    return rows.select("reply_id", texts.screen(F.col("prose"), guard).alias("prose"), "quotes", "withheld", texts.withheld_sentences(F.col("prose"), guard).alias("sentences"))


def strike_labels(text: Column, valid: Column) -> Column:
    """Labels F1, G2 ... that do not exist, replaced by a note; ``valid`` is an array of those that do."""
    between, found = F.split(text, LABEL, -1), F.regexp_extract_all(text, F.lit(LABEL), F.lit(1))
    shown = F.transform(found, lambda m: F.when(F.array_contains(valid, m), m).otherwise(F.lit(STRUCK)))
    return F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def walkthrough(steps: DataFrame, labels: DataFrame, guard: texts.Guard) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps (unit, number, text) with invented labels struck and judgments withheld, the invented labels, and the groups left out.

    ``labels`` has unit, label and group: a finding's group or, for a group, itself.
    """
    valid = labels.groupBy("unit").agg(F.collect_set("label").alias("valid"))
    rows = steps.join(valid, "unit", "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    clean = rows.select("unit", "number", texts.screen(strike_labels(F.col("text"), F.col("valid")), guard).alias("text"))
    said = steps.select("unit", F.explode(F.regexp_extract_all("text", F.lit(LABEL), F.lit(1))).alias("label")).distinct()
    invented = said.join(labels, ["unit", "label"], "left_anti")
    covered = said.join(labels, ["unit", "label"]).select("unit", "group").distinct()
    return clean, invented, labels.select("unit", "group").distinct().join(covered, ["unit", "group"], "left_anti")


def not_run(spark, suite: str, reason: str) -> DataFrame:
    """The record of a suite that did not run: a reason and no numbers."""
    return spark.createDataFrame([(suite, "not_run", reason, None)], "suite string, status string, reason string, cases long")
