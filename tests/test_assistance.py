"""Explanations, answers, repairs, citations, comparisons for readers, and text corpora."""

import hashlib
import json

import pytest
from assayer import cli
from assayer.errors import Refusal
from assayer.operators import compare, findings, provenance, texts
from assayer.plans import assistance
from assayer.sinks import reports
from assayer.sources.documents import from_texts
from assayer.sources.reports import text_corpus
from test_validate import CATALOG, finding, make_pack, spoilt, table

GUARD = texts.Guard(judging=(r"\bis compliant\b",))
PASSAGES = [("s", "one", "A property must be declared by the schema that describes it."), ("t", "two", "Nothing of interest stands here at all.")]


def recorded(spark, prompts, reply):
    rows = [(hashlib.sha256(p.encode()).hexdigest(), reply) for p in prompts]
    return spark.createDataFrame(rows, "prompt_sha256 string, reply string")


def test_findings_are_explained_from_recorded_replies(spark):
    found = table(spark, finding(location="/a", message="This property is not declared by the schema"), finding(location="/b", message="zzz", prop="qqq", citation="xxx"))
    passages = spark.createDataFrame(PASSAGES, "source string, label string, passage string")
    nothing = spark.createDataFrame([], "prompt_sha256 string, reply string")
    first = {r["ask_id"]: r for r in assistance.explain(found, passages, nothing, GUARD).collect()}
    assert first["#F1"]["skipped"] == assistance.NO_REPLY and first["#F2"]["skipped"] == assistance.NO_EVIDENCE and first["#F2"]["prompt"] is None
    reply = {"text": "It says so [Q1], [Q2]. It is compliant. Yes.", "quotes": [{"id": "Q1", "source": "s", "text": "must be declared by the schema"}, {"id": "Q2", "source": "t", "text": "must be declared by the schema"}]}
    said = recorded(spark, [first["#F1"]["prompt"]], f"```json\n{json.dumps(reply)}\n```")
    rows = {r["label"]: r for r in assistance.explain(found, passages, said, GUARD).withColumn("shown", assistance.answer_text()).collect()}
    assert rows["F1"]["prose"] == f"It says so [Q1], [quote Q2 withheld]. {texts.WITHHELD} Yes." and rows["F1"]["skipped"] is None and rows["F1"]["notes"]
    assert rows["F1"]["shown"].split("\n")[1] == "  [Q1] s: must be declared by the schema" and "withheld sentence: It is compliant." in rows["F1"]["shown"]
    assert rows["F2"]["shown"] == f"skipped: {assistance.NO_EVIDENCE}"
    broken = recorded(spark, [first["#F1"]["prompt"]], "no object at all")
    assert {r["skipped"] for r in assistance.explain(found, passages, broken, GUARD).collect()} == {assistance.NO_OBJECT, assistance.NO_EVIDENCE}


def test_questions_are_answered_beside_findings(spark):
    passages = spark.createDataFrame(PASSAGES, "source string, label string, passage string")
    questions = spark.createDataFrame([("q1", "", "what must the schema say of a property")], "ask_id string, doc_id string, question string")
    nothing = spark.createDataFrame([], "prompt_sha256 string, reply string")
    row = assistance.ask(questions, table(spark, finding()), passages, nothing, GUARD).first()
    assert row["skipped"] == assistance.NO_REPLY and "F1  ERROR C at=/a p=v" in row["prompt"] and PASSAGES[0][2] in row["prompt"]


def test_repairs_are_judged_by_what_they_do(spark, tmp_path):
    bad = spoilt(CATALOG, (("catalog", "controls", 0, "n"), 0))
    docs = from_texts(spark, {"c.json": json.dumps(bad), "d.json": json.dumps(bad), "e.json": json.dumps(bad)})
    good = json.dumps([{"op": "replace", "path": "/catalog/controls/0/n", "value": CATALOG["catalog"]["controls"][0]["n"]}])
    steps = [("c.json", good), ("d.json", '[{"op": "remove", "path": "/nowhere"}]'), ("e.json", '[{"op": "add", "path": "/catalog/x", "value": "TODO"}]')]
    proposals = spark.createDataFrame(steps, "doc_id string, patch string")
    targets = spark.createDataFrame([(d, "/catalog/controls/0/n", "DATATYPE_BELOW_MINIMUM") for d, _ in steps], "doc_id string, location string, code string")
    rows, outcomes = assistance.repair(docs, proposals, make_pack(), targets)
    said = {r["doc_id"]: r["refused"] for r in rows.collect()}
    assert said["c.json"] is None and "nowhere" in said["d.json"] and said["e.json"] == "a value is still to be written"
    assert [(r["doc_id"], r["resolved"], r["clean"]) for r in outcomes.collect()] == [("c.json", True, True)]
    (tmp_path / "in.json").write_text("{}")
    with pytest.raises(Refusal):
        assistance.write_out(str(tmp_path / "." / "in.json"), "x", [str(tmp_path / "in.json")])
    assistance.write_out(str(tmp_path / "out.json"), "x", [str(tmp_path / "in.json")])
    assert (tmp_path / "out.json").read_text() == "x"


def test_citations_come_from_the_pack(spark):
    said = {"C": {"citation": "{code} of {property} is {value} at {location}", "url": "https://x.example/", "retrieved": "2024-01-01"}}
    rows = {r["code"]: r["rule"] for r in findings.cited(table(spark, finding(), finding(code="D")), said).collect()}
    assert rows["C"].asDict() == {"citation": "C of p is v at /a", "url": "https://x.example/", "retrieved": "2024-01-01"} and rows["D"]["citation"] == "c"
    pack = make_pack()
    pack.citations = {"TYPE_MISMATCH": {"citation": "the schema gives the type"}}
    listed = {r["code"]: (r["citation"], r["url"]) for r in provenance.rules_of_codes(spark, pack).collect()}
    assert listed["TYPE_MISMATCH"] == ("the schema gives the type", "") and listed["UUID_NOT_UNIQUE"] == ("", "") and len(listed) == 22
    log = reports.sarif(findings.cited(table(spark, finding()), said), "m")
    assert log["runs"][0]["tool"]["driver"]["rules"][0]["helpUri"] == "https://x.example/"


def test_releases_of_rules_are_compared(spark):
    files = lambda **x: spark.createDataFrame(list(x.items()), "path string, sha256 string")
    changed = compare.hash_changes(files(a="1", b="2", c="3"), files(b="2", c="4", d="5"))
    assert {tuple(r) for r in changed.collect()} == {("a", "removed"), ("c", "changed"), ("d", "added")}
    nothing = changed.limit(0)
    assert compare.rules_unchanged(nothing, nothing, ("1", "1")) and not compare.rules_unchanged(nothing, nothing, ("1", "2")) and not compare.rules_unchanged(nothing, changed, ("1", "1"))
    said = compare.provenance_notes({"tool": "a 1", "rules": "r1"}, {"tool": "a 1", "rules": "r2"})
    assert said == [("after", "judged by r2, the other by r1")] and compare.provenance_notes({"tool": "a", "rules": "r"}, {"tool": "a", "rules": "r"}) == []


def test_reports_in_parts_and_for_readers(spark, tmp_path):
    found = table(spark, finding(), finding(location="/b", severity="UNVERIFIABLE"))
    for form in reports.FORMS:
        reports.write_lines(found, str(tmp_path / form), form)
    held = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {h["location"] for h in held} == {"/a", "/b"} and spark.read.text(str(tmp_path / "annotations")).count() == 2
    assert {json.loads(r["value"])["kind"] for r in spark.read.text(str(tmp_path / "sarif")).collect()} == {"fail", "open"}
    member = {"doc_id": "d", "exit_code": 1, "ERROR": 1, "WARNING": 0, "INFO": 0, "UNVERIFIABLE": 0}
    made = {"documents": [member], "import_graph": [{"doc_id": "d", "pointer": "/i", "href": "e", "resolved_to": None}], "imports_not_in_package": [], "unreferenced": ["d"], "uuid_collisions": [{"value": "u", "members": ["d", "e"]}], "exit_code": 1}
    shown = reports.package_text(made)
    assert "  d: 1 ERROR, 0 WARNING, 0 INFO, 0 UNVERIFIABLE, exit code 1" in shown and "  u: d, e" in shown and "  (none)" in shown and shown.endswith("exit code 1\n")


def test_differences_for_readers(tmp_path, capsys):
    pack = make_pack()
    (tmp_path / "rules.pack").write_text(json.dumps({"schema": pack.schema.raw, "names": {k: sorted(v) for k, v in pack.names.items()}, "release": "2"}))
    (tmp_path / "a.json").write_text(json.dumps(spoilt(CATALOG, (("catalog", "controls", 0, "n"), 0))))
    (tmp_path / "b.json").write_text(json.dumps(CATALOG))
    run = lambda *words: (cli.main(["--rules", str(tmp_path / "rules.pack"), *words]), capsys.readouterr().out)
    code, shown = run("diff", str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--format", "text")
    assert code == 0 and "removed: 1" in shown and "DATATYPE_BELOW_MINIMUM" in shown and "added: 0" in shown
    code, saved = run("validate", str(tmp_path / "a.json"), "--format", "json")
    assert code == 1 and json.loads(saved)["rules"] == "2"
    (tmp_path / "old.json").write_text(json.dumps(json.loads(saved) | {"tool": "assayer 0", "rules": ""}))
    _, made = run("diff", str(tmp_path / "old.json"), str(tmp_path / "b.json"))
    assert [n["side"] for n in json.loads(made)["notes"]] == ["before", "before"]


def test_text_corpora_are_those_of_their_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("one é", encoding="utf-8")
    (tmp_path / "b.txt").write_text("two", encoding="utf-8")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = {"x": {"path": "sub/a.txt", "sha256": digest("one é")}, "y": {"path": "none.txt", "sha256": "0"}}
    assert {tuple(r) for r in text_corpus(spark, str(tmp_path), listed).collect()} == {("x", "one é")}
    with pytest.raises(Refusal):
        text_corpus(spark, str(tmp_path), listed | {"z": {"path": "b.txt", "sha256": digest("other")}})
