"""Sources, sinks, command line, server, streaming and the driver entry."""

import io
import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from assayer import cli, server
from assayer.errors import Refusal
from assayer.operators import findings
from assayer.sinks import reports as sinks
from assayer.sources import documents, reports
from assayer.streaming import watch
from test_validate import CATALOG, PROFILE, finding, make_pack, spoilt, table

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A catalog with an error, a profile that imports it, and their rule pack."""
    top = tmp_path_factory.mktemp("docs")
    (top / "cat.json").write_text(json.dumps(spoilt(CATALOG, (("catalog", "controls", 0, "n"), 0)), indent=1), encoding="utf-8")
    (top / "prof.json").write_text(json.dumps(PROFILE), encoding="utf-8")
    pack = make_pack()
    constraints = [{"kind": c.kind, "context": c.context, "target": c.target, "identifier": c.identifier, "level": c.level, "keys": [k.target for k in c.keys], "index": c.index, "low": c.low, "high": c.high, "regex": c.regex} for c in pack.constraints]
    rules = {"schema": pack.schema.raw, "constraints": constraints, "names": {k: sorted(v) for k, v in pack.names.items()}, "release": "2"}
    (top / "rules.pack").write_text(json.dumps(rules), encoding="utf-8")
    return top


def command(folder, *words, capsys):
    code = cli.main(["--rules", str(folder / "rules.pack"), *words])
    return code, *capsys.readouterr()


def test_paths(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.json", "a.json", "c.txt", "sub/d.json"):
        (tmp_path / name).write_text("{}")
    (tmp_path / "link.json").symlink_to(tmp_path / "a.json")
    names = lambda found: [Path(f).name for f in found]
    assert names(documents.expand([str(tmp_path), str(tmp_path / "b.json")])) == ["a.json", "b.json"]
    assert names(documents.discover([str(tmp_path)])) == ["a.json", "b.json", "link.json", "d.json"]
    for bad in (documents.expand, documents.discover):
        with pytest.raises(Refusal):
            bad([str(tmp_path / "none*")])
    assert documents.inside(str(tmp_path / "a.json"), str(tmp_path))
    with pytest.raises(Refusal):
        documents.inside(str(tmp_path / "link.json"), str(tmp_path / "sub"))


def test_whole_files_are_documents(spark, folder):
    found = documents.read_documents(spark, str(folder)).collect()
    rows = {Path(r["doc_id"]).name: r["text"] for r in found}
    assert len(found) == 2 and rows["cat.json"].count("\n") > 5 and set(rows) == {"cat.json", "prof.json"} and json.loads(rows["prof.json"]) == PROFILE


def test_reports_come_back_as_they_went(spark):
    found = table(spark, finding(), finding(code="D", severity="INFO"))
    text = sinks.json_report(found.collect(), "x.json")
    assert json.loads(text)["summary"] == {"ERROR": 1, "WARNING": 0, "INFO": 1, "UNVERIFIABLE": 0}
    back = reports.read_report(spark, text).drop("doc_id")
    assert sorted(map(str, back.collect())) == sorted(map(str, found.drop("doc_id").collect()))
    value = json.loads(text)
    for spoil in ({"summary": {}}, {"version": "9.0"}, {"findings": [{}]}):
        with pytest.raises(Refusal):
            reports.check_report(value | spoil)
    broken = json.loads(text)
    broken["findings"][0]["position"] = {"file": "f", "line": 0, "column": 1}
    with pytest.raises(Refusal):
        reports.check_report(broken)
    assert set(sinks.report_schema()["properties"]) == {"version", "tool", "document", "findings", "summary"}


def test_baseline_files(spark):
    entry = {"code": "C", "location": "/a", "property": "p", "value": "v", "reason": "r", "acknowledged_on": "2024-01-01"}
    good = json.dumps({"baseline_version": 1, "entries": [entry]})
    assert reports.read_baseline(spark, good).count() == 1
    for bad in ("{", "[]", json.dumps({"baseline_version": 2, "entries": []}), json.dumps({"baseline_version": 1, "entries": [{"code": "C"}]})):
        with pytest.raises(Refusal):
            reports.read_baseline(spark, bad)


def test_targets_limits_and_pages(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\ng\thttp://a\tx,y\ng\thttp://b\n")
    rows = reports.survey_targets(spark, str(tmp_path / "t.tsv")).collect()
    assert [(r["url"], r["resolve"]) for r in rows] == [("http://a", ["x", "y"]), ("http://b", [])]
    (tmp_path / "t.tsv").write_text("g\thttp://a\ng\thttp://a\n")
    with pytest.raises(Refusal):
        reports.survey_targets(spark, str(tmp_path / "t.tsv"))
    said = reports.limits("# T\n\n## Limits\n\nBefore all.\n\n**One.** It\nstops.\n\n**Two.** More.\n\n## Next\n")
    assert said == {"preamble": "Before all.", "limits": [{"title": "One.", "text": "**One.** It stops."}, {"title": "Two.", "text": "**Two.** More."}]}
    for bad in ("", "## Limits\n\nonly\n\n## N", "## Limits\n\n**a** b\n\n**c** d\n\n## N", "## Limits\n\na\n\nb\n\n## N"):
        with pytest.raises(Refusal):
            reports.limits(bad)
    text, title = reports.page_text("<title>T &amp; x</title><nav>no</nav><h2>Head</h2><p>a  b<script>x</script></p><pre>k\n  l</pre><td>c</td>")
    assert title == "T & x" and text.startswith("## Head\n") and "a b" in text and "no" not in text and "k\n" in text


def test_pages_cut_inside_a_reference(spark):
    text, title = reports.page_text("<title>a&amp;b&amp</title><h1>a&amp;b&amp</h1><p>&copy;&copy &lt;i&gt; &#38;&#38 &ampamp; R&D</p><xmp>x & y</xmp>")
    assert title == "a&b&amp" and text == "# a&b&amp\n\n©&copy <i> &&#38 &ampamp; R&D\nx & y\n"


def test_sinks(spark):
    found = table(spark, finding(value="<b>", message="50%\nx"), finding(code="DATATYPE_MISMATCH", severity="UNVERIFIABLE", location="o.json#/q"), finding(code="UNHEARD", severity="INFO", location="/m/x"))
    text = sinks.text_report(found)
    assert text.endswith("3 finding(s): 1 ERROR, 0 WARNING, 1 INFO, 1 UNVERIFIABLE\n") and "ERROR        C  at=/a" in text
    page = sinks.html_report(found.collect(), "<d>")
    assert "&lt;b&gt;" in page and "<b>" not in page and page.index("DATATYPE_MISMATCH") < page.index("UNHEARD")
    log = sinks.check_sarif(sinks.sarif(found, "m", {"r": "00"}), 3)
    run = log["runs"][0]
    assert [r["ruleIndex"] for r in run["results"]] == [run["tool"]["driver"]["rules"].index(next(x for x in run["tool"]["driver"]["rules"] if x["id"] == r["ruleId"])) for r in run["results"]]
    kinds = {r["ruleId"]: (r["kind"], r["level"]) for r in run["results"]}
    assert kinds["DATATYPE_MISMATCH"] == ("open", "note") and kinds["C"] == ("fail", "error")
    other = next(r for r in run["results"] if r["ruleId"] == "DATATYPE_MISMATCH")["locations"][0]
    assert other["physicalLocation"]["artifactLocation"]["uri"] == "o.json" and other["logicalLocations"][0]["fullyQualifiedName"] == "/q"
    merged = sinks.merge_sarif([log, log])["runs"][0]
    assert len(merged["results"]) == 6 and merged["properties"]["summary"]["ERROR"] == 2
    with pytest.raises(Refusal):
        sinks.check_sarif(log, 4)
    lines = [r["line"] for r in sinks.annotations(found).collect()]
    assert any(line.startswith("::error file=,title=ERROR C::/a 50%25%0Ax") for line in lines)
    assert sinks.run_outputs(findings.tally(found).first(), 2, True).count("\n") == 7
    assert all(json.loads(r["json"])["rule"]["citation"] == "c" for r in sinks.records(found).collect())


def test_command_line(folder, tmp_path, capsys):
    cat, prof = str(folder / "cat.json"), str(folder / "prof.json")
    code, out, _ = command(folder, "validate", cat, "--format", "json", "--locations", capsys=capsys)
    report = json.loads(out)
    low = next(f for f in report["findings"] if f["code"] == "DATATYPE_BELOW_MINIMUM")
    assert code == 1 and low["position"]["line"] > 1
    saved = tmp_path / "saved.json"
    saved.write_text(out)
    code, out, _ = command(folder, "validate", prof, "--resolve", str(folder), capsys=capsys)
    assert code == 0 and "IMPORT_RESOLVED" in out and "0 ERROR" in out
    base = tmp_path / "base.json"
    command(folder, "validate", cat, "--write-baseline", str(base), capsys=capsys)
    code, _, err = command(folder, "validate", cat, "--baseline", str(base), capsys=capsys)
    assert code == 2 and "blank" in err
    held = json.loads(base.read_text())
    for e in held["entries"]:
        e |= {"reason": "known", "acknowledged_on": "2024-05-05"}
    base.write_text(json.dumps(held))
    code, out, _ = command(folder, "validate", cat, "--baseline", str(base), capsys=capsys)
    assert code == 0 and "acknowledged 2024-05-05: known" in out
    for shape in ("sarif", "html", "annotations"):
        code, out, _ = command(folder, "validate", cat, "--format", shape, capsys=capsys)
        assert code == 1 and "DATATYPE_BELOW_MINIMUM" in out
    clean = tmp_path / "clean.json"
    clean.write_text(json.dumps(CATALOG))
    code, out, _ = command(folder, "diff", str(saved), str(clean), "--fail-on-new", capsys=capsys)
    assert code == 0 and [f["code"] for f in json.loads(out)["removed"]] == ["DATATYPE_BELOW_MINIMUM"]
    code, out, _ = command(folder, "diff", str(clean), cat, "--fail-on-new", capsys=capsys)
    assert code == 1
    code, out, _ = command(folder, "package", str(folder), capsys=capsys)
    made = json.loads(out)
    assert code == 1 and made["exit_code"] == 1 and [Path(d).name for d in made["unreferenced"]] == ["prof.json"]
    assert json.loads(command(folder, "rule", "one-id", capsys=capsys)[1])["declarations"][0]["target"] == "//control"
    assert json.loads(command(folder, "rule", "TYPE_MISMATCH", capsys=capsys)[1])["emitted_by"] == "structure"
    assert json.loads(command(folder, "coverage", capsys=capsys)[1])["published"] == 6
    assert command(folder, "rule", "nothing", capsys=capsys)[0] == 2
    assert command(folder, "validate", str(folder / "none"), capsys=capsys)[0] == 2
    (tmp_path / "bad.json").write_text("{")
    assert command(folder, "validate", str(tmp_path / "bad.json"), capsys=capsys)[0] == 2
    assert cli.main(["report-schema"]) == 0 and cli.main(["rule", "x"]) == 2


def test_server(spark, folder, tmp_path):
    served = server.Server(spark, make_pack(), str(folder), {"preamble": "p", "limits": []})
    call = lambda name, **arguments: {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    lines = [
        {"id": 0, "method": "initialize"}, {"id": 1, "method": "tools/list"}, {"method": "note"}, call("limits"), call("coverage", kind="index"), call("rule", identifier="TYPE_MISMATCH"),
        call("validate", path=str(folder / "cat.json")), call("validate", path="/etc/hostname"), call("is-secure"), call("none"), call("rule"), {"id": 2, "method": "x"}, [],
    ]
    out = io.StringIO()
    served.serve([*(json.dumps(x) for x in lines), "not json", ""], out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(said) == 13
    content = lambda k: json.loads(said[k]["result"]["content"][0]["text"])
    assert {t["name"] for t in said[1]["result"]["tools"]} == {"validate", "rule", "coverage", "limits"}
    assert content(2)["preamble"] == "p" and content(3)["kinds"][0]["published"] == 1 and content(4)["code"] == "TYPE_MISMATCH"
    assert content(5)["exit_code"] == 1 and said[6]["result"]["exit_code"] == 2
    assert "no judgment" in said[7]["error"]["message"] and "no tool" in said[8]["error"]["message"]
    assert [s["error"]["code"] for s in said[9:]] == [-32602, -32601, -32600, -32700]


def test_streaming(spark, folder, tmp_path):
    watched = tmp_path / "in"
    watched.mkdir()
    for name in ("cat.json", "prof.json"):
        shutil.copy(folder / name, watched / name)
    query = watch.watch(watch.arriving(spark, str(watched)), make_pack(), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["code"] for r in rows} >= {"DATATYPE_BELOW_MINIMUM", "IMPORT_RESOLVED"} and {r["batch"] for r in rows} == {0}


def test_entry_without_the_text_operators(tmp_path):
    for name in ("assayer", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "assayer" / "llm")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 60, said.stderr


def test_nothing_outside_imports_the_text_operators():
    for path in (ROOT / "assayer").rglob("*.py"):
        if "llm" not in path.parts:
            assert "assayer.llm" not in path.read_text(encoding="utf-8"), path


def test_python_interface(spark, folder):
    from assayer import api

    found = api.validate_file(str(folder / "cat.json"), make_pack(), locations=True, spark=spark)
    low = next(f for f in found if f.code == "DATATYPE_BELOW_MINIMUM")
    assert low.gates and low.severity is api.Severity.ERROR and low.position.line > 1 and isinstance(low.rule, api.Rule)
    near = api.validate_file(str(folder / "prof.json"), make_pack(), [str(folder)], suggest=True, spark=spark)
    assert not any(f.gates for f in near) and api.read_report_schema()["properties"]
    assert api.REPORT_SCHEMA_VERSION == "1.0"
