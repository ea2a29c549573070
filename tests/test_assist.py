"""Checked replies, surveys and the impact of rule changes."""

import json

import pytest
from assayer.errors import Refusal
from assayer.operators import assist, scoring, texts
from assayer.plans.survey import rule_impact, survey
from assayer.sources.documents import from_texts
from pyspark.sql import functions as F
from test_validate import CATALOG, PROFILE, finding, make_pack, spoilt, table


GUARD = texts.Guard(judging=(r"\bis (?:\w+ )?(?:compliant|ready|secure)\b",), boundary=(r"\bwhether\b", r"\bcannot\b"))


def test_what_is_shown(spark):
    found = table(spark, *[finding(location=f"/m/{k}") for k in range(5)], finding(location="/m/a/b", severity="UNVERIFIABLE"))
    said = assist.context(found, 4).first()["context"].split("\n")
    assert len(said) == 5 and said[0].startswith("F1  ERROR C at=/m/0 p=v") and said[-1] == "... and 2 more"
    docs = from_texts(spark, {"": '{"m": {"a": {"b": 1, "c": [2]}}}'})
    part = {r["location"]: r["excerpt"] for r in assist.excerpts(found, docs).collect()}
    assert json.loads(part["/m/a/b"]) == {"b": 1, "c": [2]} and json.loads(part["/m/0"]) == {"a": {"b": 1, "c": [2]}}
    noted = {r["severity"]: r["notes"] for r in assist.notes(found).collect()}
    assert len(noted["UNVERIFIABLE"]) == 2 and len(noted["ERROR"]) == 1


def test_replies_are_checked(spark):
    sources = spark.createDataFrame([("s", "The identifier must be unique in the whole catalog, says the text."), ("t", "Nothing else")], "source string, text string")
    quotes = [("Q1", "s", "must be unique in the whole catalog"), ("Q2", "s", "must be pretty in the whole catalog"), ("Q3", "z", "must be unique in the whole catalog")]
    long = "The identifier must be unique in the whole catalog"
    prose = f'It says [Q1] and [Q2], [Q9]. "{long}" but "{long} forever". The system is fully compliant. Done.'
    replies = spark.createDataFrame([(1, prose, quotes), (2, "Plain.", [])], "reply_id int, prose string, quotes array<struct<id:string,source:string,text:string>>")
    rows = {r["reply_id"]: r for r in assist.verify(replies, sources, GUARD).collect()}
    assert rows[1]["prose"] == f'It says [Q1] and [quote Q2 withheld], [quote Q9 withheld]. "{long}" but {texts.INLINE_WITHHELD}. {texts.WITHHELD} Done.'
    assert [q["id"] for q in rows[1]["quotes"]] == ["Q1"] and [w["id"] for w in rows[1]["withheld"]] == ["Q2", "Q3"]
    assert rows[1]["sentences"] == ["The system is fully compliant."] and rows[2]["prose"] == "Plain."


def test_walkthroughs_name_findings_that_exist(spark):
    labels = spark.createDataFrame([("u", "F1", "G1"), ("u", "F2", "G2"), ("u", "G1", "G1"), ("u", "G2", "G2")], "unit string, label string, group string")
    steps = spark.createDataFrame([("u", 1, "First F1, then F7. It is ready.")], "unit string, number int, text string")
    clean, invented, uncovered = assist.walkthrough(steps, labels, GUARD)
    assert clean.first()["text"] == f"First F1, then {assist.STRUCK}. {texts.WITHHELD}"
    assert [r["label"] for r in invented.collect()] == ["F7"] and [r["group"] for r in uncovered.collect()] == ["G2"]


def test_recorded_replies(spark):
    prompts = spark.createDataFrame([(1, "hello")], "prompt_id int, prompt string")
    cassettes = prompts.select(F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"), F.lit("hi").alias("reply"))
    assert assist.replay(prompts, cassettes).first()["reply"] == "hi"
    with pytest.raises(Refusal):
        assist.replay(prompts.withColumn("prompt", F.lit("other")), cassettes)
    assert assist.not_run(spark, "s", "no key").first()["cases"] is None


def test_surveys_record_what_they_cannot_read(spark):
    targets = from_texts(spark, {"p.json": json.dumps(PROFILE), "bad.json": "{", "c.json": json.dumps(spoilt(CATALOG, (("catalog", "controls", 0, "n"), 0)))})
    support = from_texts(spark, {"cat.json": json.dumps(CATALOG)})
    records, found = survey(targets, support, make_pack())
    rows = {r["doc_id"]: r for r in records.collect()}
    assert rows["bad.json"]["outcome"] == "not read" and rows["p.json"]["complete"] and rows["p.json"]["imports_resolved"] == 1
    assert rows["c.json"]["errors"] == 1 and rows["c.json"]["codes"]["DATATYPE_BELOW_MINIMUM"] == 1 and rows["c.json"]["model"] == "catalog"
    total = scoring.survey_summary(records).first()
    assert (total["targets"], total["validated"], total["not_read"], total["with_errors"]) == (3, 2, 1, 1)
    with pytest.raises(Refusal):
        survey(targets, from_texts(spark, {"worse.json": "{"}), make_pack())
    assert {r["doc_id"] for r in found.collect()} == {"p.json", "c.json"}


def test_impact_of_rules(spark):
    new = make_pack().add(kind="has-cardinality", context="catalog", target="control", high=1, identifier="few")
    rows = rule_impact(from_texts(spark, {"c.json": json.dumps(CATALOG)}), make_pack(), new).collect()
    assert [(r["code"], r["added"], r["removed"]) for r in rows] == [("CONSTRAINT_CARDINALITY", 1, 0)]
