"""Reports of a run: JSON, text, HTML, SARIF, annotations and run outputs.

Columns do the work for each finding; the driver only joins finished lines of
the one document or package that a person asked to see. For tables of many
documents the row forms are written by Spark instead.
"""

from __future__ import annotations

import html
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from assayer import __version__
from assayer.errors import Refusal
from assayer.operators.findings import ORDER, OTHER, RANK, SEVERITIES, TIERS, fingerprint
from assayer.operators.provenance import CODES
from assayer.sources.reports import REPORT_VERSION

NO_POSITION = "(no source position)"
#: Kind and level of a result by severity; what could not be verified is open and never a pass.
SARIF_KIND = {"ERROR": ("fail", "error"), "WARNING": ("fail", "warning"), "INFO": ("informational", "note"), "UNVERIFIABLE": ("open", "note")}
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
FINGERPRINT = "assayFinding/v1"


def record(row: Row, locations: bool = False) -> dict[str, Any]:
    """A finding as reports carry it: what is absent has no key, but a position that was asked for is null if unknown."""
    made = {"code": row["code"], "severity": row["severity"], "location": row["location"], "property": row["prop"], "value": row["value"], "message": row["message"]}
    made["rule"] = row["rule"].asDict() if row["rule"] else {"citation": "", "url": "", "retrieved": ""}
    if row["suggestions"]:
        made["suggestions"] = [s.asDict() for s in row["suggestions"]]
    if row["acknowledged"]:
        made["acknowledged"] = row["acknowledged"].asDict()
    if locations:
        made["position"] = row["position"].asDict() if row["position"] else None
    return made


def records(found: DataFrame) -> DataFrame:
    """doc_id and json: one JSON record a finding, for tables of any size."""
    fields = ["code", "severity", "location", F.col("prop").alias("property"), "value", "message", "rule", "suggestions", "acknowledged", "position"]
    return found.select("doc_id", F.to_json(F.struct(*fields)).alias("json"))


def _summary(rows: list[Row]) -> dict[str, int]:
    return {s: sum(r["severity"] == s for r in rows) for s in SEVERITIES}


def json_report(rows: list[Row], document: str, baseline: str = "", locations: bool = False, rules: str = "") -> str:
    """The report of one document, keys sorted; ``rules`` names what it was judged by."""
    made: dict[str, Any] = {
        "version": REPORT_VERSION, "tool": f"assayer {__version__}", "document": document,
        "findings": [record(r, locations) for r in rows], "summary": _summary(rows),
    }
    if rules:
        made["rules"] = rules
    if baseline:
        made["baseline"] = {
            "path": baseline, "acknowledged": sum(r["acknowledged"] is not None for r in rows), "stale": sum(r["code"] == "BASELINE_STALE" for r in rows),
        }
    return json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def text_lines(locations: bool = False) -> Column:
    """One finding in the fixed layout of the text report."""
    place = F.concat(F.lit("  "), F.coalesce(F.concat(F.col("position.file"), F.lit(":"), F.col("position.line").cast("string"), F.lit(":"), F.col("position.column").cast("string")), F.lit(NO_POSITION)))
    lines = [
        F.concat(F.rpad("severity", 12, " "), F.lit(" "), "code", F.lit("  at="), "location", place if locations else F.lit("")),
        F.concat(F.lit("    "), "prop", F.lit(" = "), "value"),
        F.concat(F.lit("    "), "message"),
        F.concat(F.lit("    rule: "), F.col("rule.citation")),
        F.when(F.col("rule.url") != "", F.concat(F.lit("    source: "), F.col("rule.url"), F.lit(" (retrieved "), F.col("rule.retrieved"), F.lit(")"))),
        F.when(F.col("acknowledged").isNotNull(), F.concat(F.lit("    acknowledged "), F.col("acknowledged.acknowledged_on"), F.lit(": "), F.col("acknowledged.reason"))),
    ]
    offered = F.transform("suggestions", lambda s: F.concat(F.lit("    also declared: "), s["value"], F.lit("  (differs by "), s["difference"], F.lit(")")))
    return F.concat_ws("\n", *lines, F.array_join(offered, "\n"))


def text_report(found: DataFrame, locations: bool = False) -> str:
    """All findings of a run and the line of counts."""
    rows = found.orderBy("doc_id", *ORDER).select(text_lines(locations).alias("line"), "severity").collect()
    counts = _summary(rows)
    shown = ", ".join(f"{n} {s}" for s, n in counts.items())
    return "".join(r["line"].rstrip() + "\n" for r in rows) + f"{len(rows)} finding(s): {shown}\n"


def annotation(value: Column, is_property: bool = False) -> Column:
    """A value as a workflow command may carry it."""
    for mark, written in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if is_property else ())):
        value = F.replace(value, F.lit(mark), F.lit(written))
    return value


def annotations(found: DataFrame) -> DataFrame:
    """doc_id and line: one workflow command a finding, without a line number where there is none."""
    level = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARNING", "warning").otherwise("notice")
    file = F.coalesce("position.file", "doc_id")
    place = F.when(F.col("position").isNotNull(), F.concat(F.lit(",line="), F.col("position.line").cast("string"), F.lit(",col="), F.col("position.column").cast("string"))).otherwise("")
    title = F.concat("severity", F.lit(" "), "code")
    line = F.concat(F.lit("::"), level, F.lit(" file="), annotation(file, True), place, F.lit(",title="), annotation(title, True), F.lit("::"), annotation(F.concat("location", F.lit(" "), "message")))
    return found.select("doc_id", line.alias("line"))


def split_location(location: Column, model: Column) -> Column:
    """file and pointer of a location; the file is null for the document itself."""
    own = (location == F.concat(F.lit("/"), model)) | location.startswith(F.concat(F.lit("/"), model, F.lit("/")))
    other = ~own & location.rlike("^[^#]+#/")
    return F.struct(
        F.when(other, F.regexp_extract(location, "^([^#]+)#", 1)).alias("file"), F.when(other, F.regexp_replace(location, "^[^#]+#", "")).otherwise(location).alias("pointer")
    )


def sarif_results(found: DataFrame, model: str) -> DataFrame:
    """The results of a log as rows, one a finding, for tables of any size: doc_id, rule_id, kind, level, uri, pointer, message, fingerprint."""
    place = split_location(F.col("location"), F.lit(model))
    by_severity = lambda k: F.create_map(*[F.lit(x) for s, pair in SARIF_KIND.items() for x in (s, pair[k])])[F.col("severity")]
    return found.select(
        "doc_id", F.col("code").alias("rule_id"), by_severity(0).alias("kind"), by_severity(1).alias("level"), F.coalesce(place["file"], "doc_id").alias("uri"), place["pointer"].alias("pointer"),
        F.concat("prop", F.lit(" = "), "value", F.lit(". "), "message").alias("message"), fingerprint().alias("fingerprint"),
    )


def sarif_rules(found: DataFrame) -> DataFrame:
    """The rules of a log as rows, one a code: id, description, help (the one link that its findings cite, else null), results."""
    link = F.when(F.col("rule.url").rlike("^https?://"), F.col("rule.url"))
    said = F.create_map(*[F.lit(x) for code, _, what in CODES for x in (code, what)])
    rows = found.groupBy(F.col("code").alias("id")).agg(F.collect_set(link).alias("links"), F.count("*").alias("results"))
    return rows.select("id", F.coalesce(F.try_element_at(said, F.col("id")), "id").alias("description"), F.when(F.size("links") == 1, F.get("links", F.lit(0))).alias("help"), "results")


#: Row forms of reports that Spark writes itself.
FORMS = {
    "json": lambda found: records(found).select("json"), "text": lambda found: found.select(text_lines(True)), "annotations": lambda found: annotations(found).select("line"),
    "sarif": lambda found: sarif_results(found, "").select(F.to_json(F.struct("*"))),
}


def write_lines(found: DataFrame, folder: str, form: str = "json") -> None:
    """The findings of any number of documents as text files below a folder, written where they are computed."""
    FORMS[form](found).toDF("value").write.text(folder)


def package_text(made: dict[str, Any]) -> str:
    """The report of a package for readers: members, what holds across them, and the verdict."""
    lines = ["members"]
    for m in made["documents"]:
        lines.append(f"  {m['doc_id']}: " + ", ".join(f"{m[s]} {s}" for s in SEVERITIES) + f", exit code {m['exit_code']}")
    edge = lambda e: f"  {e['doc_id']} {e['pointer']} -> {e['href']}" + (f" ({e['resolved_to']})" if e["resolved_to"] else "")
    sections = {
        "imports": [edge(e) for e in made["import_graph"]], "imports not in the package": [edge(e) for e in made["imports_not_in_package"]],
        "named by no other member": [f"  {d}" for d in made["unreferenced"]],
        "identifiers of several members": [f"  {c['value']}: {', '.join(c['members'])}" for c in made["uuid_collisions"]],
    }
    for title, rows in sections.items():
        lines += [title, *(rows or ["  (none)"])]
    return "\n".join([*lines, f"exit code {made['exit_code']}"]) + "\n"


def diff_text(made: dict[str, Any]) -> str:
    """A comparison for readers: notes first, then what changed, then what could not be paired."""
    lines = [f"note ({n['side']}): {n['note']}" for n in made["notes"]]
    for status in ("removed", "added", "changed", "moved"):
        lines.append(f"{status}: {len(made[status])}")
        lines += [f"  {f['severity']} {f['code']} at={f['location']} {f['property']} = {f['value']}" for f in made[status]]
    lines += [f"  {c['location']} {c['field']}: {c['before']} -> {c['after']}" for c in made["fields"]]
    lines.append(f"unchanged: {made['unchanged']}")
    lines += [f"moved or not, this could not be decided: {place}" for place in made["undecided"]]
    return "\n".join(lines) + "\n"


def sarif(found: DataFrame, model: str, digests: dict[str, str] | None = None) -> dict[str, Any]:
    """The run as a SARIF log; rules are the codes met, in order, with a help link where all findings cite one."""
    rows = found.withColumns({"print": fingerprint(), "place": split_location(F.col("location"), F.lit(model))}).orderBy("doc_id", *ORDER).collect()
    met = sorted({r["code"] for r in rows})
    said = {code: what for code, _, what in CODES}
    rules = []
    for code in met:
        urls = {r["rule"]["url"] for r in rows if r["code"] == code and r["rule"] and (r["rule"]["url"] or "").startswith(("http://", "https://"))}
        rules.append({"id": code, "shortDescription": {"text": said.get(code, code)}} | ({"helpUri": urls.pop()} if len(urls) == 1 else {}))
    results = []
    for r in rows:
        kind, level = SARIF_KIND[r["severity"]]
        where: dict[str, Any] = {"artifactLocation": {"uri": r["place"]["file"] or r["doc_id"]}}
        if r["position"]:
            where["region"] = {"startLine": r["position"]["line"], "startColumn": r["position"]["column"]}
        name = r["place"]["pointer"].rsplit("/", 1)[-1]
        result = {
            "ruleId": r["code"], "ruleIndex": met.index(r["code"]), "kind": kind, "level": level, "message": {"text": f"{r['prop']} = {r['value']}. {r['message']}"},
            "locations": [{"physicalLocation": where, "logicalLocations": [{"name": name, "fullyQualifiedName": r["place"]["pointer"]}]}],
            "partialFingerprints": {FINGERPRINT: r["print"]},
        }
        if r["acknowledged"]:
            result["suppressions"] = [{"kind": "external", "justification": r["acknowledged"]["reason"]}]
        results.append(result)
    driver = {"name": "assayer", "version": __version__, "rules": rules}
    run: dict[str, Any] = {"tool": {"driver": driver}, "results": results, "properties": {"summary": _summary(rows)}}
    if digests:
        run["artifacts"] = [{"location": {"uri": u}, "hashes": {"sha-256": d}} for u, d in sorted(digests.items())]
    return {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [run]}


def merge_sarif(logs: list[dict[str, Any]]) -> dict[str, Any]:
    """Several logs as one run: rules united and pointed at anew, summaries added; the tools must agree."""
    runs = [r for log in logs for r in log["runs"]]
    if not runs or len({(r["tool"]["driver"]["name"], r["tool"]["driver"]["version"]) for r in runs}) != 1:
        raise Refusal("logs of different tools or versions are not merged")
    rules = {rule["id"]: rule for r in runs for rule in r["tool"]["driver"]["rules"]}
    order = sorted(rules)
    results = [x | {"ruleIndex": order.index(x["ruleId"])} for r in runs for x in r["results"]]
    summary = {s: sum(r["properties"]["summary"][s] for r in runs) for s in SEVERITIES}
    driver = runs[0]["tool"]["driver"] | {"rules": [rules[k] for k in order]}
    return {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}, "results": results, "properties": {"summary": summary}}]}


def check_sarif(log: dict[str, Any], findings: int) -> dict[str, Any]:
    """The log, refused unless it is one run with as many results as the report has findings."""
    if len(log["runs"]) != 1 or len(log["runs"][0]["results"]) != findings:
        raise Refusal("the log does not hold every finding of the report")
    return log


def html_report(rows: list[Row], document: str) -> str:
    """One page without outside parts: findings grouped by code in the order of fixing, every value escaped."""
    tier_of = {code: (k, tier) for k, (tier, codes) in enumerate(TIERS) for code in codes}
    groups: dict[str, list[Row]] = {}
    for r in rows:
        groups.setdefault(r["code"], []).append(r)
    esc = lambda s: html.escape(str(s if s is not None else ""), quote=True)
    counts = _summary(rows)
    parts = [
        "<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8">', f"<title>Report on {esc(document)}</title>",
        "<style>body{font-family:sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #888;padding:.3em .6em;text-align:left}code{word-break:break-all}</style>",
        f"</head><body><main><h1>Report on {esc(document)}</h1>", "<table><caption>Findings by severity</caption><tr>",
        "".join(f'<th scope="col">{s}</th>' for s in counts) + "</tr><tr>" + "".join(f"<td>{n}</td>" for n in counts.values()) + "</tr></table>",
    ]
    for code in sorted(groups, key=lambda c: (tier_of.get(c, (len(TIERS), OTHER))[0], c)):
        held = groups[code]
        highest = max((r["severity"] for r in held), key=RANK.get)
        parts.append(f"<section><h2>{esc(code)} ({esc(highest)}, {len(held)})</h2><p>{esc(tier_of.get(code, (0, OTHER))[1])}</p><ul>")
        for r in held:
            seen = f" <em>acknowledged {esc(r['acknowledged']['acknowledged_on'])}: {esc(r['acknowledged']['reason'])}</em>" if r["acknowledged"] else ""
            parts.append(f"<li><code>{esc(r['location'])}</code> {esc(r['prop'])} = <code>{esc(r['value'])}</code>. {esc(r['message'])} <small>{esc(r['rule']['citation'])}</small>{seen}</li>")
        parts.append("</ul></section>")
    return "\n".join([*parts, "</main></body></html>\n"])


def package_report(totals: DataFrame, graph: DataFrame, absent: DataFrame, unreferenced: DataFrame, collisions: DataFrame) -> dict[str, Any]:
    """Members with their counts, and what holds across them."""
    members = [r.asDict() for r in totals.orderBy("doc_id").collect()]
    edges = lambda df: [r.asDict() for r in df.select("doc_id", "pointer", "href", "resolved_to").orderBy("doc_id", "pointer").collect()]
    return {
        "version": REPORT_VERSION, "tool": f"assayer {__version__}", "documents": members, "import_graph": edges(graph), "imports_not_in_package": edges(absent),
        "unreferenced": [r[0] for r in unreferenced.orderBy("doc_id").collect()], "uuid_collisions": [r.asDict() for r in collisions.orderBy("value").collect()],
        "summary": {s: sum(m[s] for m in members) for s in SEVERITIES}, "exit_code": max((m["exit_code"] for m in members), default=0),
    }


def run_outputs(tally: Row, documents: int, failed: bool) -> str:
    """Seven named counters, a line each."""
    named = {
        "documents": documents, "errors": tally["ERROR"], "warnings": tally["WARNING"], "infos": tally["INFO"], "unverifiable": tally["UNVERIFIABLE"],
        "acknowledged": tally["acknowledged"], "failed": str(failed).lower(),
    }
    return "".join(f"{k}={v}\n" for k, v in named.items())


def report_schema() -> dict[str, Any]:
    """The published shape of the JSON report."""
    text = {"type": "string"}
    finding = {
        "type": "object", "required": ["code", "severity", "location", "property", "value", "message", "rule"],
        "properties": {
            "code": {"enum": [c for c, _, _ in CODES]}, "severity": {"enum": list(SEVERITIES)}, "location": text, "property": text, "value": text, "message": text,
            "rule": {"type": "object", "properties": {k: text for k in ("citation", "url", "retrieved")}},
            "suggestions": {"type": "array", "items": {"type": "object", "properties": {"value": text, "difference": text}}},
            "acknowledged": {"type": "object", "properties": {"reason": text, "acknowledged_on": text}},
            "position": {"type": ["object", "null"], "properties": {"file": text, "line": {"type": "integer", "minimum": 1}, "column": {"type": "integer", "minimum": 1}}},
        },
    }
    return {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["version", "tool", "document", "findings", "summary"],
        "properties": {
            "version": text, "tool": text, "document": text, "findings": {"type": "array", "items": finding},
            "summary": {"type": "object", "required": list(SEVERITIES), "additionalProperties": False, "properties": {s: {"type": "integer", "minimum": 0} for s in SEVERITIES}},
        },
    }
