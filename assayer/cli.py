"""Command line: validate a document, a package, compare two runs, look up a rule, check coverage, or serve.

Exit codes: 0 no finding gates, 1 a finding gates, 2 the run was refused.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from assayer import __version__
from assayer.durable import cut
from assayer.errors import Refusal
from assayer.operators import baseline, compare, findings, imports, package, positions
from assayer.operators.evaluate import evaluate
from assayer.plans.validate import validate
from assayer.rules.pack import RulePack, pack_of, read_modules
from assayer.server import Server
from assayer.session import session
from assayer.sinks import reports
from assayer.sources.documents import expand, read_documents
from assayer.sources.reports import is_report, limits, read_baseline, read_report


def load_pack(path: str) -> RulePack:
    """A rule pack from its JSON file: schema, and constraints or modules (paths beside it), names and release."""
    try:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        folder = Path(path).parent
        schema = held["schema"] if isinstance(held["schema"], dict) else json.loads((folder / held["schema"]).read_text(encoding="utf-8"))
        more = {k: held[k] for k in ("release", "source", "value_keys", "citations") if k in held}
        more["guard"] = {k: tuple(v) for k, v in held.get("guard", {}).items()}
        more["models_of"] = {m: frozenset(v) for m, v in held.get("models_of", {}).items()}
        if "modules" in held:
            return read_modules(schema, {m: (folder / m).read_text(encoding="utf-8") for m in held["modules"]}, **more)
        return pack_of(schema, held.get("constraints", ()), names=held.get("names", {}), **more)
    except (OSError, ValueError, KeyError, TypeError) as error:
        raise Refusal(f"{path} is no rule pack that can be read: {error}") from error


def _judged(spark: SparkSession, pack: RulePack, path: str, resolve: list[str], suggest: bool = False, locations: bool = False) -> DataFrame:
    files = expand([path])
    documents = read_documents(spark, sorted({*files, *expand(resolve)}), pattern="*")
    mine = spark.createDataFrame([(f,) for f in files], "doc_id string")
    found = validate(documents, pack, mine, suggest)
    return findings.attach_positions(found, positions.source_index(documents)) if locations else found


def _side(spark: SparkSession, pack: RulePack, path: str, resolve: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Findings of one side, and what they rest on."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        value = json.loads(text)
    except ValueError as error:
        raise Refusal(f"{path}: {error}") from error
    if is_report(value):
        if resolve:
            raise Refusal("a saved report is not resolved again")
        return read_report(spark, text).withColumn("doc_id", _nothing()), {"tool": str(value["tool"]), "rules": str(value.get("rules", ""))}
    return _judged(spark, pack, path, resolve).withColumn("doc_id", _nothing()), {"tool": f"assayer {__version__}", "rules": pack.release}


def _nothing():
    from pyspark.sql import functions as F

    return F.lit("")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="assayer", description=__doc__)
    parser.add_argument("--version", action="version", version=f"assayer {__version__}")
    parser.add_argument("--rules", help="rule pack (JSON)")
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("validate")
    one.add_argument("file")
    one.add_argument("--resolve", nargs="*", default=[])
    one.add_argument("--format", choices=("text", "json", "sarif", "html", "annotations"), default="text")
    one.add_argument("--suggest", action="store_true")
    one.add_argument("--locations", action="store_true")
    one.add_argument("--baseline")
    one.add_argument("--fail-on", choices=("error", "warning", "info"), default="error")
    one.add_argument("--fail-on-stale", action="store_true")
    one.add_argument("--write-baseline")
    many = verbs.add_parser("package")
    many.add_argument("folder")
    many.add_argument("--format", choices=("text", "json"), default="json")
    many.add_argument("--records", help="folder that all findings are written to, in parts")
    two = verbs.add_parser("diff")
    two.add_argument("before")
    two.add_argument("after")
    two.add_argument("--resolve", nargs="*", default=[])
    two.add_argument("--fail-on-new", action="store_true")
    two.add_argument("--format", choices=("text", "json"), default="json")
    look = verbs.add_parser("rule")
    look.add_argument("identifier")
    verbs.add_parser("coverage")
    verbs.add_parser("report-schema")
    serve = verbs.add_parser("serve")
    serve.add_argument("--root", default=".")
    serve.add_argument("--limits", help="Markdown file with a section of limits")
    return parser


def _validate(spark: SparkSession, pack: RulePack, args: argparse.Namespace) -> int:
    found = cut(_judged(spark, pack, args.file, args.resolve, args.suggest, args.locations))
    if args.baseline:
        found = cut(baseline.apply(found, read_baseline(spark, Path(args.baseline).read_text(encoding="utf-8"))))
    if args.write_baseline:
        entries = [r.asDict() for r in baseline.draft(found).orderBy("location", "property", "code", "value").collect()]
        Path(args.write_baseline).write_text(json.dumps({"baseline_version": baseline.VERSION, "entries": entries}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    rows = found.orderBy("doc_id", *findings.ORDER)
    if args.format == "text":
        sys.stdout.write(reports.text_report(found, args.locations))
    elif args.format == "json":
        sys.stdout.write(reports.json_report(rows.collect(), args.file, args.baseline or "", args.locations, pack.release))
    elif args.format == "html":
        sys.stdout.write(reports.html_report(rows.collect(), args.file))
    elif args.format == "annotations":
        sys.stdout.write("".join(r["line"] + "\n" for r in reports.annotations(rows).collect()))
    else:
        model = Path(args.file).read_text(encoding="utf-8")
        log = reports.check_sarif(reports.sarif(found, next(k for k in json.loads(model) if k != "$schema")), found.count())
        sys.stdout.write(json.dumps(log, indent=2, sort_keys=True) + "\n")
    return int(not found.where(findings.gates(found, args.fail_on, args.fail_on_stale)).isEmpty())


def _package(spark: SparkSession, pack: RulePack, args: argparse.Namespace) -> int:
    documents = read_documents(spark, args.folder)
    found = cut(validate(documents, pack))
    facts = cut(evaluate(documents, pack, ("scalar",)))
    met, _ = imports.closure(documents, facts.where("kind = 'scalar'"), documents)
    uuids = facts.where("kind = 'scalar' AND name = 'uuid' AND jtype = 'string'")
    made = reports.package_report(
        package.totals(found, documents), package.import_graph(met), package.not_in_package(met), package.unreferenced(documents, met), package.collisions(uuids)
    )
    if args.records:
        reports.write_lines(found, args.records)
    sys.stdout.write(reports.package_text(made) if args.format == "text" else json.dumps(made, indent=2, sort_keys=True) + "\n")
    return made["exit_code"]


def _diff(spark: SparkSession, pack: RulePack, args: argparse.Namespace) -> int:
    (before, rests_on), (after, now_on) = (_side(spark, pack, path, args.resolve) for path in (args.before, args.after))
    compared = cut(compare.compare(before, after))
    counts = compare.summary(compared).first().asDict()
    shown = {s: [r["f"] for r in compared.where(compared.status == s).selectExpr("coalesce(after, before) AS f").collect()] for s in ("removed", "added", "changed", "moved")}
    made: dict = {s: [reports.record(f) for f in sorted(rows, key=lambda f: (f["location"], f["prop"], f["code"]))] for s, rows in shown.items()}
    made["unchanged"] = counts["unchanged"]
    made["notes"] = [{"side": side, "note": note} for side, note in compare.provenance_notes(rests_on, now_on)]
    made["fields"] = [r.asDict() for r in compare.changes(compared).select("location", "field", "before", "after").orderBy("location", "field").collect()]
    made["undecided"] = sorted({r["f"]["location"] for r in compared.where("undecided").selectExpr("coalesce(after, before) AS f").collect()})
    sys.stdout.write(reports.diff_text(made) if args.format == "text" else json.dumps(made, indent=2, sort_keys=True) + "\n")
    return int(args.fail_on_new and not compare.new_errors(compared).isEmpty())


def main(argv: list[str] | None = None) -> int:
    """Runs one command and returns its exit code."""
    args = _parser().parse_args(argv)
    try:
        if args.verb == "report-schema":
            sys.stdout.write(json.dumps(reports.report_schema(), indent=2, sort_keys=True) + "\n")
            return 0
        if not args.rules:
            raise Refusal("--rules is needed: the engine judges by the rules that it is given")
        pack, spark = load_pack(args.rules), session()
        if args.verb in ("validate", "package", "diff"):
            return {"validate": _validate, "package": _package, "diff": _diff}[args.verb](spark, pack, args)
        said = limits(Path(args.limits).read_text(encoding="utf-8")) if args.verb == "serve" and args.limits else {}
        server = Server(spark, pack, getattr(args, "root", "."), said)
        if args.verb == "serve":
            server.serve(sys.stdin, sys.stdout)
        else:
            answer = server.rule(args.identifier) if args.verb == "rule" else server.coverage()
            sys.stdout.write(json.dumps(answer, indent=2, sort_keys=True) + "\n")
        return 0
    except (Refusal, OSError) as refusal:
        sys.stderr.write(f"refused: {refusal}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
